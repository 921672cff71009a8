"""Benchmark decontamination by a prefix-filtered set join.  DataFrame functions only.

A *window* is `size` consecutive words of a benchmark item, or all words of an item of fewer.  A window that occurs in a
document has all of its shingles (`shingle` words, fewer if the window has fewer) there, so one of them is a necessary
prefix: the one that is rarest in the corpus.

1. Occurrences of the benchmark's shingles are counted over all documents; a window is dropped if any of its
   shingles occurs nowhere.
2. The shingles of the documents are joined with the windows' rarest ones.  The place of the match gives the place
   where the window would have to begin; it must not begin before the text or end after it.
3. The words there are compared with those of the window.

The windows of a benchmark are broadcast in blocks of at most BLOCK rows (counted; one block but for very large benchmarks,
each further block reads the documents' words again), so texts are never shuffled: what moves is a row per document and
one per occurrence, by document.

Defined cases: a null or empty text, or one of other characters only, has no words and no hits; an item without words has no
windows; items of one id are one item, and an item without an id makes hits but is not listed; repeated rows and null ids of
documents are rows of their own; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable

#: Fixed by the task: words are runs of digits, lower-case letters (after lower-casing A-Z) and code points beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (an item's window each) of a broadcast.
BLOCK = 200_000


def words_of(text: Column) -> Column:
    """The words of a text, only A-Z lower-cased; `lower` does that faster where all characters are ASCII."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item string, window array<string>): the distinct windows of each item."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(size - 1)))
    return rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("window")).distinct()


def _key(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def _own_shingles(window: Column, shingle: int) -> Column:
    """[(key, offset)] of a window."""
    def keys(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(window) - F.lit(n)), lambda i: F.struct(_key([F.get(window, i + j) for j in range(n)]).alias("key"), i.alias("offset")))

    out = keys(shingle)
    for n in range(shingle - 1, 0, -1):
        out = F.when(F.size(window) == n, keys(n)).otherwise(out)
    return out


def _placed(numbered: DataFrame, sizes: list[int], keep: tuple[str, ...]) -> DataFrame:
    """`numbered` (row, words, ...) with a row for each shingle: place and key, null in place and key for texts without words."""
    most = max(sizes, default=1)
    zipped = F.arrays_zip(*[F.col("words") if j == 0 else F.slice("words", F.lit(j + 1), F.greatest(F.size("words"), F.lit(1))) for j in range(most)])
    rows = numbered.select(*keep, F.posexplode_outer(zipped).alias("place", "z"))
    word = [F.col("z").getField("words" if j == 0 else str(j)) for j in range(most)]
    keys = [F.when(word[n - 1].isNotNull(), _key(word[:n])) for n in sizes]
    return rows.select(*keep, "place", keys[0].alias("key") if len(keys) == 1 else F.explode(F.array(*keys)).alias("key"))


def rarest(numbered: DataFrame, listed: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """(item, window, offset, key): each window that can occur, with its rarest shingle in the documents and its place."""
    own = listed.select("item", "window", F.explode(_own_shingles(F.col("window"), shingle)).alias("s")).select("item", "window", "s.*")
    wanted = durable(own.select("key").distinct())
    shingles = _placed(numbered.select("words"), sizes, ()).where(F.col("key").isNotNull()).select("key")
    if wanted.count() <= BROADCAST_ROWS:
        counts = shingles.join(F.broadcast(wanted), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = shingles.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(wanted, "key", "left_semi")
    known = own.join(counts, "key", "left").groupBy("item", "window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key"), F.col("offset"))).alias("first")
    )
    return known.where(F.col("first.n") > 0).select("item", "window", "first.key", "first.offset")


def matches(numbered: DataFrame, prefixes: DataFrame, sizes: list[int], header: bool) -> DataFrame:
    """(row, id, n, begin, end, item) of each occurrence; with `header` a row without an occurrence for each document too."""
    rows = _placed(numbered, sizes, ("row", "id", "words"))
    windows_of = F.broadcast(prefixes.withColumnRenamed("key", "w_key"))
    joined = rows.join(windows_of, F.col("key") == F.col("w_key"), "left" if header else "inner")
    begin, size = F.col("place") - F.col("offset"), F.size("window")
    inside = (begin >= 0) & (begin + size <= F.size("words"))
    same = F.coalesce(F.when(inside, F.slice("words", F.greatest(begin, F.lit(0)) + 1, size) == F.col("window")), F.lit(False))
    found = joined.select("row", "id", F.size("words").alias("n"), "place", same.alias("same"), begin.alias("begin"), (begin + size).alias("end"), "item")
    held = F.col("same") | F.coalesce(F.col("place") == 0, F.lit(True)) if header else F.col("same")
    return found.where(held).select("row", "id", "n", *[F.when(F.col("same"), F.col(c)).alias(c) for c in ("begin", "end", "item")])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """(id_col, n_words long, n_hit long, hits array<struct<begin, end>>, items array<string>) of every document.

    `hits` are the occurrences of windows as word numbers, in order; `items` the ids of items with one, sorted as strings.
    """
    shingle = min(shingle, size)
    listed = durable(windows(benchmark, size, item_col, item_text_col))
    lengths = [r[0] for r in listed.select(F.least(F.size("window"), F.lit(shingle))).distinct().collect()]  # at most `shingle` of them
    sizes = sorted(lengths, reverse=True) or [shingle]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    prefixes = durable(rarest(numbered, listed, sizes, shingle))
    blocks = max(1, -(-prefixes.count() // block))
    if blocks > 1:
        numbered = durable(numbered)
    found = matches(numbered, prefixes if blocks == 1 else prefixes.where(F.pmod("key", F.lit(blocks)) == 0), sizes, True)
    for k in range(1, blocks):
        found = found.unionByName(matches(numbered, prefixes.where(F.pmod("key", F.lit(blocks)) == k), sizes, False))
    span = F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))
    rows = found.groupBy("row").agg(F.first("id").alias(id_col), F.first("n").cast("long").alias("n_words"), F.array_sort(F.collect_set(span)).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, h: F.struct(F.greatest(acc["reach"], h["end"]).alias("reach"), (acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["begin"], acc["reach"]))).alias("n"))
    return rows.select(id_col, "n_words", F.aggregate("hits", zero, step, lambda acc: acc["n"]).alias("n_hit"), "hits", "items")
