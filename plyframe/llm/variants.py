"""Spelling variants: words one edit apart, grouped under their frequent form, by rolling-hash deletions.

1. Words of all documents are counted in Arrow batches (runs of letters as integer spans) and summed by Spark.  Words
   in the order of falling counts, then of code points, get increasing ids, so the best of several words has the least id.
2. Two words are one edit apart if one is the other without a code point, or if both are the same without the code point at
   one place.  NumPy makes the hash of each such deletion from polynomial hashes of the prefix and the suffix, for a whole
   batch at once: 8 bytes for a deletion, whatever the length of the word.  (key, place, id) rows are dealt by the high bits of
   the key and sorted; groups of equal keys with a pair in them are kept.
3. Their rows are joined with the words, and grouped again by the string that the deletion leaves, so that words whose
   hashes collide do not count.  A group is never listed as pairs: each word needs the size of its groups and their best
   other word only.  A string has at most 90 * (length + 1) words around it.
4. A word's form is its best near word if that is `ratio` times as frequent.  Frequencies grow by that factor along forms, so
   a few doublings of the step reach every word's root.

Letters are A-Z, a-z and U+00C0 to U+00FF, all below 256: words are sequences of single bytes inside tasks.

Defined cases: a null or empty text has no words; a null id is written as an empty string in the key of planted misspellings;
repeated rows count again; texts of any length are counted in pieces cut between words; an empty table gives no words;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_arrow, slices
from .textbytes import LOWER, PIECE, hash_spans, mix, pieces, powers, utf8

#: Bytes before which a text can be cut: those of ASCII that are no letters, and first bytes of code points that are none.
_CUT = np.zeros(256, bool)
_CUT[:128] = ~np.array([chr(b).isalpha() for b in range(128)])
_CUT[0xC4:] = _CUT[0xC2] = True
#: High bits of a key that rows are dealt by.
RADIX = 16


def _shifts(most: int) -> np.ndarray:
    """[n, k, v]: the CRC-32 remainder of byte v at place k of a remainder, n zero bytes later."""
    byte = np.arange(256, dtype=np.uint32)
    table = byte.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = byte[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most + 1):
        out[n] = (out[n - 1] >> 8) ^ table[out[n - 1] & 0xFF]
    return out


_SHORT = 64
_SHIFTS = _shifts(_SHORT)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, begin, end, text) of the lower-cased runs of letters of UTF-8 texts; code points are single bytes."""
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    plain = LOWER[data]
    inside = lead | tail | ((plain >= 97) & (plain <= 122))
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    keep = inside[begin]
    begin, end = begin[keep], end[keep]
    shown = inside & ~lead
    place = np.concatenate([[0], np.cumsum(shown)])
    points = np.where(tail, data + np.uint8(0x40), plain)[shown]
    return points, place[begin], place[end], np.searchsorted(offsets, begin, "right") - 1


def _distinct(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct word, number of the word of each place); equal hashes are verified letter by letter."""
    _, first, word = np.unique(hash_spans(points, begin, end), return_index=True, return_inverse=True)
    size, like = end - begin, first[word]
    same = (size == size[like]).all()
    if same:
        same = (points == points[np.arange(len(points)) + np.repeat(begin[like] - begin, size)]).all()  # words fill `points`
    if not same:
        raw, known = points.tobytes(), {}
        word = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        _, first = np.unique(word, return_index=True)
    return first, word


def tally(data: np.ndarray, offsets: np.ndarray, prefixes: list[bytes], least: int, every: int | None) -> Counter:
    """Counts of the words of `least` code points and more of one piece; `prefixes` are the keys of its texts.

    With `every`, a code point is deleted from each word the CRC-32 of whose key and text it divides.
    """
    points, begin, end, text = letters(data, offsets)
    out: Counter = Counter()
    if not len(begin):
        return out
    first, word = _distinct(points, begin, end)
    raw = points.tobytes()
    shown = [raw[a:b].decode("latin-1") for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
    total = np.bincount(word, minlength=len(first))
    if every:
        pair, n = np.unique(text * len(first) + word, return_counts=True)
        doc, own = pair // len(first), pair % len(first)
        coded = [w.encode() for w in shown]
        size = np.array([len(w) for w in coded])
        before = np.array([zlib.crc32(p) for p in prefixes], np.uint32)[doc]
        row = _SHIFTS[np.minimum(size, _SHORT)[own]]
        at = np.arange(len(own))
        moved = row[at, 0, before & 0xFF] ^ row[at, 1, before >> 8 & 0xFF] ^ row[at, 2, before >> 16 & 0xFF] ^ row[at, 3, before >> 24]
        key = (moved ^ np.array([zlib.crc32(w) for w in coded], np.uint32)[own]).astype(np.int64)
        for i in np.flatnonzero(size[own] > _SHORT).tolist():
            key[i] = zlib.crc32(prefixes[doc[i]] + coded[own[i]])
        for i in np.flatnonzero(key % every == 0).tolist():
            k = int(own[i])
            total[k] -= n[i]
            gone = int(key[i]) % len(shown[k])
            if len(shown[k]) > least:
                out[shown[k][:gone] + shown[k][gone + 1 :]] += int(n[i])
    for k in np.flatnonzero((total > 0) & (end[first] - begin[first] >= least)).tolist():
        out[shown[k]] += int(total[k])
    return out


def count_words(docs: DataFrame, least: int, every: int | None, id_col: str, text_col: str) -> DataFrame:
    """(word, n): the occurrences of each word of `least` code points and more in all texts."""

    def run(batches):
        for batch in slices(batches, text_col):
            prefixes = [f"{i}:".encode() for i in batch.column(id_col).to_pylist()]
            data, offsets = utf8(batch.column(text_col))
            for a, b in pieces(data, offsets, PIECE, _CUT):
                low, high = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
                found = tally(data[a:b], np.clip(offsets[low : high + 1] - a, 0, b - a), prefixes[low:high], least, every)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    plain = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(id_col), text_col)
    return in_arrow(plain, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, word) of each deletion of the words, and of the words themselves with place -1.

    The hash of a prefix is a difference of running sums, that of the suffix one power lower, as it moves left by one.
    """
    up, down = powers(len(points) + 2)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])
    size = end - begin
    word = np.repeat(np.arange(len(begin)), size)
    at = np.arange(len(points))
    start, stop = begin[word], end[word]
    left = (total[at] - total[start]) * down[start]
    right = (total[stop] - total[at + 1]) * down[start + 1]
    whole = (total[end] - total[begin]) * down[begin]
    return mix(np.concatenate([whole, left + right])), np.concatenate([np.full(len(begin), -1), at - start]), np.concatenate([np.arange(len(begin)), word])


def _keys(words: DataFrame) -> DataFrame:
    """(key, place, id, head) of all words; `head` marks the first of several places whose deletion leaves the same string."""

    def run(batches):
        for batch in slices(batches, "word"):
            raw = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            end = np.cumsum([len(w) for w in raw])
            begin = end - [len(w) for w in raw]
            points = np.frombuffer(b"".join(raw), np.uint8)
            key, place, word = deletion_keys(points, begin, end)
            head = np.ones(len(points), bool)
            head[1:] = points[1:] != points[:-1]
            head[begin] = True
            ids = batch.column("id").to_numpy()[word]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place, pa.int32()), pa.array(ids), pa.array(np.concatenate([np.zeros(len(begin), bool), head]))], ["key", "place", "id", "head"])

    return in_arrow(words.select("id", "word"), run, "key long, place int, id long, head boolean")


def _meeting(batches):
    """Of rows sorted by key and place, those of groups of equal keys with two words one edit apart."""
    rest = None
    for batch in (*batches, None):
        table = pa.Table.from_batches([b for b in (rest, batch) if b is not None]) if rest is not None or batch is not None else None
        if table is None or not table.num_rows:
            continue
        table = table.combine_chunks()
        key, place, head = (table.column(c).to_numpy() for c in ("key", "place", "head"))
        cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))  # the last group may go on
        rest = table.slice(cut).combine_chunks().to_batches()[0] if cut < len(key) else None
        if not cut:
            continue
        key, place, head = key[:cut], place[:cut], head[:cut]
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        one = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
        spot = np.cumsum(one) - 1
        several = np.bincount(spot)[spot] > 1
        whole = np.bincount(group, place < 0)[group] > 0
        parts = np.bincount(group, head)[group] > 0
        keep = (place >= 0) & several | whole & head | (place < 0) & parts
        if keep.any():
            yield from table.slice(0, cut).filter(pa.array(keep)).select(["place", "id", "head"]).combine_chunks().to_batches()


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words (id, word) are one edit from each, and the least id among these."""
    dealt = _keys(words).repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key", "place", "id")
    met = in_arrow(dealt, _meeting, "place int, id long, head boolean").join(words.select("id", "word"), "id")
    left = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.length("word"))))
    rows = met.select("id", "place", "head", left.alias("left"))
    around, spot = Window.partitionBy("left"), Window.partitionBy("left", "place")
    ordered = spot.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.select(
        "id", "place", "head",
        F.max(F.when(F.col("place") < 0, F.col("id"))).over(around).alias("whole"), F.count_if("head").over(around).alias("parts"), F.min(F.when(F.col("head"), F.col("id"))).over(around).alias("part"),
        F.count(F.lit(1)).over(spot).alias("several"), F.min("id").over(spot).alias("first"), F.nth_value("id", 2).over(ordered).alias("second"),
    )
    other = F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second"))
    longer = F.when(F.col("head"), F.col("whole"))
    one = F.col("place") < 0
    n = F.when(one, F.col("parts")).otherwise(F.col("several") - 1 + longer.isNotNull().cast("long"))
    best = F.when(one, F.col("part")).otherwise(F.least(other, longer))
    return seen.select("id", n.alias("n"), best.alias("best")).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, root) of the words (id, up) with a form, after `rounds` doublings of the step."""
    now = edges
    for _ in range(rounds):
        further = now.select(F.col("id").alias("up"), F.col("up").alias("further"))
        now = durable(now.join(further, "up", "left").select("id", F.coalesce("further", "up").alias("up")))
    return now.select("id", F.col("up").alias("root"))


def group(
    docs: DataFrame, least: int = 6, occurrences: int = 5, ratio: int = 5, misspell: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `least` letters and `occurrences` occurrences.

    `form` is the most frequent word one edit away if it is `ratio` times (2 or more) as frequent, else null; `root` is where forms
    end, the word itself if it has none.  `misspell` plants a deletion in about one of so many words, for evaluation.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent")
    counted = durable(count_words(docs, least, misspell, id_col, text_col).where(F.col("n") >= occurrences))
    words = durable(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = durable(words.join(near_words(words), "id", "left").join(best, "best", "left").withColumn("fits", F.coalesce(F.col("form_n") >= F.col("n") * ratio, F.lit(False))))
    chain, most = 0, words.agg(F.max("n")).first()[0] or 0
    while occurrences * ratio ** (chain + 1) <= most:
        chain += 1  # forms that one word can have, one after another
    ends = roots(near.where("fits").select("id", F.col("best").alias("up")), max(chain - 1, 0).bit_length())
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    shown = near.join(named, "id", "left")
    keep = lambda c: F.when(F.col("fits"), F.col(c)).alias(c)
    return shown.select("word", keep("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), keep("form_n"))
