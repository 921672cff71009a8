"""Spelling variants, periodic runs and benchmark windows against plain computations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.llm import decontaminate, periodic, queries, variants
from tests.against import connect, rows_of, rows_of_sql

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11: spelling variants


def plain_counts(rows, least, every):
    counts = Counter()
    for doc, text in rows:
        for run in LETTERS.findall(text or ""):
            word = low(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=6, occurrences=5, ratio=5, every=None):
    n = {w: c for w, c in plain_counts(rows, least, every).items() if c >= occurrences}
    around, whole = defaultdict(set), set(n)
    buckets = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            buckets[w[:i] + w[i + 1 :]].add(w)
    for left, ws in buckets.items():
        group = ws | ({left} & whole)
        for a in group:
            around[a] |= {b for b in group if b != a and near(a, b)}
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "-", root(w), n[w], len(around[w]), n[form[w]] if form[w] else -1) for w in n)


def got_variants(df):
    return sorted((r.word, r.form or "-", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_forms_equal_brute_force(make, odd_rows):
    rng, words = random.Random(4), []
    for _ in range(30):
        base = "".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9)))
        for k in range(4):
            at, c = rng.randrange(len(base)), rng.choice("abcdÿ")
            words += [rng.choice([base, base[:at] + base[at + 1 :], base[:at] + c + base[at:], base[:at] + c + base[at + 1 :]])] * (6 ** rng.randrange(1, 5) // 6 + k)
    words += ["aaaaaa"] * 30 + ["aaaaaaa"] * 6 + ["aaaaaaaa"] * 5 + ["x" * 5000] * 6 + ["x" * 4999 + "y"] * 5 + ["ÀÀÀÀÀÀ"] * 5 + ["mot×mot÷"] * 5
    rng.shuffle(words)
    rows = odd_rows + [(100 + i, rng.choice([" ", "—", "中", "_1"]).join(words[i::40])) for i in range(40)]
    for every in (None, 7):
        assert got_variants(variants.group(make(rows), misspell=every)) == plain_variants(rows, every=every)
    assert variants.group(make([])).count() == 0


def test_chains_of_forms_reach_their_root(make):
    words = ["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdhg"] * 125 + ["abcihg"] * 625 + ["abjihg"] * 3125
    got = {w: (form, root) for w, form, root, *_ in got_variants(variants.group(make([(i, " ".join(words[i::9])) for i in range(9)])))}
    assert {root for _, root in got.values()} == {"abjihg"} and got["abcdef"] == ("abcdeg", "abjihg") and got["abjihg"] == ("-", "abjihg")


def test_pieces_and_remainders_of_words(monkeypatch):
    """Cut into small pieces, with long words and all CRC lengths, counts stay the same."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abÿÀZ") for _ in range(rng.randrange(1, 90))) + rng.choice(["", "é", "中", "ā"]) for _ in range(60)) for _ in range(8)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = Counter()
    for a, b in variants.pieces(data, offsets, 200, variants._CUT):
        lo, hi = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        found += variants.tally(data[a:b], np.clip(offsets[lo : hi + 1] - a, 0, b - a), [f"{i}:".encode() for i in range(lo, hi)], 2, 5)
    assert found == plain_counts(list(enumerate(texts)), 2, 5)


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    data = np.frombuffer("abc abd abc xyz".encode(), np.uint8)
    monkeypatch.setattr(variants, "hash_spans", lambda points, begin, end: np.zeros(len(begin), np.uint64))
    assert variants.tally(data, np.array([0, len(data)]), [b"1:"], 1, None) == {"abc": 2, "abd": 1, "xyz": 1}


def test_keys_that_collide_make_no_variants(make, monkeypatch):
    rows = [(1, " ".join(["abcdef", "abcdeg", "zzzzzz", "qwertyu"] * 5))]
    want = got_variants(variants.group(make(rows)))
    words = make([(i, w) for i, w in enumerate(["abcdef", "abcdeg", "zzzzzz", "qwertyu"])]).select(F.col("doc_id").alias("id"), F.col("text").alias("word"))
    monkeypatch.setattr(variants, "_keys", lambda w: w.select(F.lit(7).cast("long").alias("key"), F.explode(F.sequence(F.lit(-1), F.length("word") - 1)).alias("place"), "id", F.lit(True).alias("head")).withColumn("head", F.col("place") >= 0))
    assert {r.id: (r.n_near, r.best) for r in variants.near_words(words).collect() if r.n_near} == {0: (1, 1), 1: (1, 0)} and want == plain_variants(rows)


def test_registered_variants(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert got_variants(queries.op11_spelling_variants(spark, tables)) == plain_variants(rows, every=199)


# --- 12: periodic runs


def plain_runs(words, least=24, times=3):
    n, seen = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                seen.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in seen.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequences():
    rng = random.Random(8)
    yield from ([], [1] * 23, [1] * 24, [1] * 400, list(range(200)), [1, 2] * 12, ([1] * 30 + [2]) * 5, list(range(40)) * 3, [0] + list(range(40)) * 3 + [0], list(range(100)) * 2)
    fibonacci = [[1], [1, 2]]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield fibonacci[-1]
    yield [bin(i).count("1") % 2 for i in range(512)]
    for k in range(120):
        letters, out = rng.choice([1, 2, 3, 50, 10**6]), []
        while len(out) < rng.randrange(30, 500):
            unit = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64]))]
            reps = rng.choice([1, 1, 2, 3, 4, 9])
            out += (unit * reps)[: len(unit) * reps - rng.randrange(len(unit))]
            if rng.random() < 0.3:
                out[rng.randrange(len(out))] = rng.randrange(letters)
        yield out


@pytest.mark.parametrize(("least", "times"), [(24, 3), (3, 3), (10, 4)])
def test_runs_equal_brute_force(least, times):
    for ids in sequences():
        assert periodic.runs_of(np.array(ids, np.int64), least, times) == plain_runs(ids, least, times), ids


def test_long_periods_and_one_word(make):
    long = [f"w{i}" for i in range(30_000)]
    assert periodic.runs_of(np.array(([*range(30_000)] * 4)[:110_000] + [7]), 24, 3) == [(0, 110_000, 30_000)]
    assert periodic.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    got = periodic.find(make([(1, " ".join(long * 3)), (2, "a\t" * 50)])).orderBy("doc_id").collect()
    assert [r.runs for r in got] == [[(0, 90_000, 30_000)], [(0, 50, 1)]] and got[0].collapsed == " ".join(long) and got[1].collapsed == "a"


def test_find_takes_odd_rows(make, odd_rows):
    rows = odd_rows + [(8, "  a b " * 30)]
    got = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.find(make(rows)).collect()), key=str)
    want = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words) if len(words) < 1000 else got[[g[0] for g in got].index(4)][2]
        want.append((doc, len(words), tuple(map(tuple, runs)), plain_collapse(words, runs)))
    assert got == sorted(want, key=str) and periodic.find(make([])).count() == 0
    with pytest.raises(ValueError):
        periodic.find(make(rows), times=2)


def test_registered_runs(spark, tables):
    want = []
    for doc, text in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if n < 2500 else periodic.runs_of(np.unique(words, return_inverse=True)[1])
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        want.append((doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(plain_collapse(words, runs))))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, tables).collect()]
    assert sorted(got) == sorted(want) and any(g[1] for g in got)


# --- 13: benchmark decontamination


def plain_hits(rows, items, size=10):
    by_size = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = ITEM_WORD.findall(low(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            by_size[min(size, len(w))][tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in rows:
        w = ITEM_WORD.findall(low(text))
        hit, found = set(), set()
        for n, known in by_size.items():
            for i in range(len(w) - n + 1):
                if (owners := known.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 7])
@pytest.mark.parametrize("short", [False, True])
def test_hits_equal_brute_force(spark, make, odd_rows, short, block):
    rng = random.Random(3)
    text = lambda n, pool: [f"{rng.choice(['', 'É', 'Ab'])}{rng.randrange(pool)}" for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([10, 11, 25]), 5))) for i in range(12)] + [(30 + i, " ".join(text(20, 10**6))) for i in range(6)]
    items += [(items[3][0], "Another text of item three, eight nine ten eleven"), (50, items[12][1]), (None, items[13][1]), (51, None), (52, "..."), (53, "")]
    if short:
        items += [(60, "three"), (61, "É1 Ab2"), (62, "one two three"), (63, "one two three four")]
    rows = list(odd_rows)
    for k in range(60):
        words = text(rng.randrange(0, 60), rng.choice([3, 5, 400]))
        for _ in range(rng.randrange(3)):
            w = ITEM_WORD.findall(rng.choice(items)[1] or "")
            at = rng.randrange(len(words) + 1)
            words[at:at] = w[rng.randrange(4) :][: rng.choice([8, 9, 10, 14, 99])]
        rows.append((100 + k, rng.choice([" ", ", ", " - "]).join(words)))
    got = decontaminate.contaminated(make(rows), items_of(spark, items), block=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == plain_hits(rows, items)
    assert all(len({i for h in r.hits for i in range(h.begin, h.end)}) == r.n_hit for r in got)


def test_benchmark_or_documents_without_rows(spark, make):
    rows = [(1, "a b c"), (2, None)]
    assert [(r.n_words, r.n_hit) for r in decontaminate.contaminated(make(rows), items_of(spark, [])).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]
    assert decontaminate.contaminated(make([]), items_of(spark, [(1, "a b c")])).count() == 0


def test_decontamination_without_python_and_equal_to_sql(spark, tables):
    df = queries.op13_decontamination(spark, tables)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan.replace("Scan ExistingRDD", ""))
    assert rows_of(df) == rows_of_sql(connect(tables), queries.oracle_sql()["op13_decontamination"])
