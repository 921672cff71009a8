"""Operators over documents against plain computations on small fixtures."""

import bisect
import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plyframe.llm import bpe, lines, mixing, ngram_join, quality, queries, toxicity
from tests.against import connect, rows_of, rows_of_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, n):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def component_ids(rows, n, percent):
    sets, root = [shingle_set(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return sorted(((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def family(seed, copies, words=60, edits=3):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rnd.randrange(edits)):
            own[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


# --- 3: n-gram Jaccard join


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(make, odd_rows, n, percent, monkeypatch):
    texts = family(1, 40) + family(2, 12) + family(3, 3, 20) + [f"Unique Text number {i} of the LOT" for i in range(20)]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts)]
    for heavy, block in ((64, 4096), (4, 3)):  # with and without clusters and blocks
        monkeypatch.setattr(ngram_join, "HEAVY", heavy)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        members, _ = ngram_join.join(make(rows), n, percent)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in members.collect()), key=str) == component_ids(rows, n, percent)


@pytest.mark.parametrize(("n", "percent", "heavy"), [(3, 90, 2), (3, 90, 10_000), (5, 80, 10_000), (1, 80, 10_000)])
def test_links_between_sets_of_different_size(make, monkeypatch, n, percent, heavy):
    """Copies with words inserted or cut, whose own n-grams are rare and so stand before the shared ones."""
    rng, rows = random.Random(n), []
    for k in range(12):
        text = [f"d{k}w{i}" for i in range(rng.choice([300, 950]))]
        rows.append((len(rows), " ".join(text)))
        for share in (0.02, 0.05, 0.1, 0.15):
            at = rng.randrange(len(text))
            more = [f"x{len(rows)}w{i}" for i in range(int(share * len(text)))]
            rows.append((len(rows), " ".join(text[:at] + more + text[at:])))
            rows.append((len(rows), " ".join(text[: int(len(text) * (1 - share))])))
            few = set(rng.sample(range(len(text)), max(1, int(share * len(text)) // 8)))
            rows.append((len(rows), " ".join(w for i, w in enumerate(text[: int(len(text) * (1 - share / 2))]) if i not in few)))
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    members, _ = ngram_join.join(make(rows), n, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in members.collect()), key=str) == component_ids(rows, n, percent)


def test_every_shared_column_counts(make):
    """950 and 1000 n-grams, 940 shared: own ones stand before and among the shared ones of the first block."""
    rng, rows = random.Random(1), []
    both = [f"c{i}" for i in range(940)]
    for k in range(6):
        a, b = [f"a{k}_{i}" for i in range(10)], [f"b{k}_{i}" for i in range(60)]
        mine = [f"{k}{w}" for w in both]
        rows += [(2 * k, " ".join(mine + a)), (2 * k + 1, " ".join(mine + b))]
    rng.shuffle(rows)
    members, _ = ngram_join.join(make(rows), 1, 90)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in members.collect()), key=str) == component_ids(rows, 1, 90)


def test_join_of_an_empty_table(make):
    members, links = ngram_join.join(make([]))
    assert members.count() == 0 and links.count() == 0


def test_one_document_of_each_group_stays(make, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(family(5, 20))]
    kept = sorted((r.doc_id for r in ngram_join.distinct_documents(make(rows)).collect()), key=str)
    ids = {(d, c) for d, _, c in component_ids(rows, 5, 80)}
    empty = {1, 2, 3}
    assert kept == sorted([d for d, _ in rows if d is None or d in empty or (d, d) in ids], key=str)


def test_one_row_of_each_group_stays(make):
    """Repeated rows, copies without id and copies whose id another text uses."""
    a, b, c = ("the first text of some words here", "a second one that is quite different", "third and alone it stands in this")
    rows = [(4, a), (4, a), (4, a), (None, a), (5, a), (5, b), (9, b), (None, c), (None, c), (3, None), (3, None)]
    got = ngram_join.distinct_documents(make(rows), repeats=False).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(4, a), (5, b), (None, c), (3, None), (3, None)], key=str)


# --- 10: line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
    return row[-1]


def deduped(rows, edits, shortest):
    """Texts after removal of the lines within `edits` of an earlier one; rows that repeat id and text count once."""
    seen, out = [], {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[doc, text] = None
            continue
        kept = []
        for line in text.split("\n"):
            far = len(line) >= shortest
            if not far or all(abs(len(line) - len(o)) > edits or distance(line, o) > edits for o in seen):
                kept.append(line)
            if far:
                seen.append(line)
        out[doc, text] = "\n".join(kept)
    return out


@pytest.mark.parametrize("limit, light, tile, run, frequent, held", [(lines.BROADCAST_ROWS, lines.LIGHT, lines.TILE, lines.RUN, lines.FREQUENT, lines.HELD), (-1, 3, 4, 3, 2, 9), (50, 20, 8, 10, 99, 25)])
def test_line_dedup_equals_brute_force(make, odd_rows, limit, light, tile, run, frequent, held, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)  # with and without a broadcast of the repeated lines
    monkeypatch.setattr(lines, "LIGHT", light)  # with and without crowded entries, in several tiles
    monkeypatch.setattr(lines, "TILE", tile)
    for name, value in (("RUN", run), ("FREQUENT", frequent), ("HELD", held)):  # with and without marked entries and long ones
        monkeypatch.setattr(lines, name, value)
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(8, 40))) for _ in range(12)]
    rows = [r for r in odd_rows if r[0] != 4]
    for i in range(40):
        picked = []
        for _ in range(rnd.randrange(1, 5)):
            line = list(rnd.choice(base))
            for _ in range(rnd.randrange(4)):
                line[rnd.randrange(len(line))] = rnd.choice("abcxyz")
            picked.append("".join(line))
        rows.append((200 + i, "\n".join(picked)))
    want = deduped(rows, 2, 10)
    # the order among rows of one id goes by a hash of the text; this fixture has no two texts of one id
    got = [(r.doc_id, r.text, r.n_dropped) for r in lines.dedup(make(rows), 2, 10).collect()]
    expected = [(doc, want[doc, text]) for doc, text in rows]
    assert sorted(((d, t) for d, t, _ in got), key=str) == sorted(expected, key=str)
    assert lines.dedup(make([])).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rnd = random.Random(edits)
    a = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(30))) for _ in range(600)]
    b = ["".join(c for c in x if rnd.random() > 0.05) + rnd.choice(["", "a", "bb"]) for x in a]
    assert lines.within(a, b, edits).tolist() == [distance(x, y) <= edits for x, y in zip(a, b, strict=True)]


def test_line_dedup_keeps_columns_of_any_name(make, monkeypatch):
    line = "a line that is long enough to count"
    made = ("_row_key", "_gone", "_g_key", "h", "near", "places", "n_lines")
    docs = make([(1, line), (2, f"{line}\nmore"), (3, None)]).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in made})
    for limit in (lines.BROADCAST_ROWS, -1):
        monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)
        got = {r.doc_id: r for r in lines.dedup(docs).collect()}
        assert [(got[i].text, got[i].n_dropped, got[i].n_chars) for i in (1, 2, 3)] == [(line, 0, len(line)), ("more", 1, 4), (None, 0, 0)]
        assert all(got[i][c] == f"{c}{i}" for i in got for c in made[:-1]) and [got[i].n_lines for i in (1, 2)] == [1, 2]


def test_documents_without_a_line_left_go(make):
    line = "a line that is long enough to count"
    assert sorted(r.doc_id for r in lines.keep(make([(1, line), (2, line), (3, ""), (4, None), (5, f"{line}\nmore")])).collect()) == [1, 3, 4, 5]


# --- 7: byte-level BPE


def test_bpe_equals_the_library_and_round_trips(make, odd_rows):
    rows = odd_rows + [(50, "Hello  world's 123,456\n\n  tabs\tand 漢字 🙂 \u0000 end "), (51, "x" * 3000), (52, ("ab12 it's\n" * 4000))]
    enc = bpe.encoding(queries.RANKS, queries.PATTERN)
    got = bpe.encode(make(rows), queries.RANKS, queries.PATTERN, decoded=True)
    want = sorted(((d, enc.encode_ordinary(t or "")) for d, t in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=str) == want
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in got.collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    again = bpe.decode(got.drop("decoded"), queries.RANKS, queries.PATTERN)
    assert sorted((bytes(r.decoded) for r in again.collect())) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode(make([]), queries.RANKS, queries.PATTERN).count() == 0


def test_safe_boundaries_change_nothing():
    enc = bpe.encoding(queries.RANKS, queries.PATTERN)
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choice(["a", "Word", " ", "  ", "\n", "'s", "9", "é", "!", "\t", "\u00a0", "\u3000", "\x1c", "слово", "漢", "かな", "。", "，", "한글", "'", "\u0301", "🙂"]) for _ in range(300))
        assert bpe.encode_text(text, enc, chunk=7).tolist() == enc.encode_ordinary(text)
        assert "".join(bpe.parts(text, 7)) == text


@pytest.mark.parametrize("sentence", ["Съешь ещё этих мягких булок, да выпей чаю. ", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία. ", "نص حكيم له سر قاطع وذو شأن عظيم. ", "我能吞下玻璃而不伤身体，真的没有关系。", "いろはにほへとちりぬるを。", "키스의고유조건은，입술끼리만나야하고。"])
def test_texts_of_a_megabyte_are_cut_in_every_script(sentence):
    enc = bpe.encoding(queries.RANKS, queries.PATTERN)
    text = sentence * (1 + (1 << 20) // len(sentence.encode()))
    own = list(bpe.parts(text, 1 << 16))
    assert "".join(own) == text and len(own) > 3 and max(map(len, own)) < (1 << 16) + 100
    assert bpe.encode_text(text, enc, 1 << 16).tolist() == enc.encode_ordinary(text)


def test_local_ranks_are_the_public_ones():
    assert isinstance(bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), queries.PATTERN), tiktoken.Encoding)


def test_bpe_query_digests(spark, tables):
    rows = {r.doc_id: r for r in queries.op7_byte_bpe(spark, tables).collect()}
    enc = bpe.encoding(queries.RANKS, queries.PATTERN)
    for doc in spark.read.parquet(f"{tables}/documents.parquet").collect():
        ids = enc.encode_ordinary(doc.text or "")
        r = rows[doc.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((doc.text or "").encode()).hexdigest())


# --- 9: mixing


def test_mix_equals_sql(spark, tables):
    assert rows_of(queries.op9_curriculum_mix(spark, tables)) == rows_of_sql(connect(tables), queries.OP9_SQL)


def test_mix_of_odd_rows(make, odd_rows):
    rows = mixing.plan(make(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert abs(sum(t for t, _ in by.values()) - total) < 1e-6 * max(total, 1)
    assert all(abs(t - taken) <= 1 for t, taken in by.values())
    assert mixing.plan(make([])).count() == 0


def test_positions_follow_the_schedule(make):
    docs = make([(i, " ".join(["w"] * 10)) for i in range(300)])
    copies = mixing.curriculum(mixing.plan(docs)).collect()
    at = [c.position for c in copies]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 3000
    early = lambda s: sum(c.words for c in copies if c.source == s and c.position < 1500) / sum(c.words for c in copies if c.source == s)
    assert early("s0") > 0.53 and early("s2") < 0.42  # heavy sources fade, light ones grow


# --- 1: quality


def test_junk_is_rejected_and_clean_text_kept(spark, make):
    rnd = random.Random(8)
    good = lambda: " ".join(rnd.choice(["the", "of", "river", "house", "walks", "green", "in", "stone"]) for _ in range(60)) + "."
    junk = lambda: " ".join(rnd.choice(["BUY!!", "NOW!!", "CHEAP$$$", "WIN!!"]) for _ in range(60))
    rows = [(i, good() if i % 5 else junk()) for i in range(400)] + [(900, None), (901, ""), (902, " ")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)] + [(3, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    decisions, model, least = quality.resample(make(rows), labels, bits=12)
    got = {r.doc_id: r.kept for r in decisions.collect()}
    assert got == {i: bool(i % 5) for i in range(400)} | {900: False, 901: False, 902: False}
    assert {r.doc_id for r in quality.keep(make(rows), labels, bits=12).collect()} == {i for i in range(400) if i % 5}
    assert quality.keep(make(rows), labels, bits=12).columns == make([]).columns
    assert quality.resample(make([]), labels.limit(0), bits=8)[0].count() == 0


def test_kth_largest_is_exact(spark):
    values = [random.Random(i).gauss(0, 10 ** (i % 5)) for i in range(500)] + [1.5] * 20
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ranked = sorted(values, reverse=True)
    assert all(quality.kth_largest(df, "v", k, bins=16) == ranked[k - 1] for k in (1, 7, 250, 520))
    assert quality.kth_largest(df, "v", 0) is None and quality.kth_largest(df, "v", 9999) == ranked[-1]


def test_top_k_draws_k(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    decisions = quality.resample(docs, labels, share=0.25)[0]
    assert decisions.where("kept").count() == round(0.25 * decisions.where("log_weight is not null").count())


def plain_ngrams(text):
    """The tokens of a text and its pairs of neighbours, each named by its bucket, found one text at a time."""
    import pyarrow as pa

    tokens = re.findall("[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\x20\x09-\x0D]+", text or "")
    bucket = lambda t: int(quality.ngrams(pa.array([t]), 10)[0][-1])  # noqa: E731  the last one: of a pair, that of the pair
    glued = lambda a, b: f"{a} {b}"
    return [bucket(t) for t in tokens] + [bucket(glued(a, b)) for a, b in zip(tokens, tokens[1:], strict=False)]


def test_weights_keys_and_draw_equal_a_plain_computation(spark, make, odd_rows):
    """Both models, log weights, keys and the kept set; short texts, so that the noise takes part in the draw."""
    rnd = random.Random(11)
    good, junk = ["the", "of", "river", "house", "walks"], ["BUY!!", "NOW!!", "the", "of", "$9"]
    rows = [(i, " ".join(rnd.choice(good if i % 3 else junk) for _ in range(rnd.randrange(1, 6)))) for i in range(300)] + [r for r in odd_rows if r[0] not in (4, None)] + [(8, "w" * 100_000), (9, "x y " * 30_000)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    decisions, model, least = quality.resample(docs, labels, bits=10, share=0.5)
    fits = {r.doc_id for r in quality.labelled(labels, 40_000, "doc_id", "quality").where("good and fits").collect()}
    raw, target, grams = Counter(), Counter(), [(d, plain_ngrams(t)) for d, t in rows]
    for d, own in grams:
        raw.update(own)
        target.update(own if d in fits else [])
    share = lambda c, b: math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * 1024))
    assert all(abs(model.ratio[b] - (share(target, b) - share(raw, b))) < 1e-12 for b in range(1024))
    noise = {r.doc_id: -math.log(-math.log((r.h % (1 << 52) + 0.5) / (1 << 52))) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    want = [(d, len(own), sum(share(target, b) - share(raw, b) for b in own) - model.cut * len(own) + model.prior if own else None) for d, own in grams]
    keys = sorted((w + noise[d] for d, _, w in want if w is not None), reverse=True)
    k = round(0.5 * len(keys))
    got = sorted(decisions.collect(), key=lambda r: (r.doc_id, r.n_ngrams))
    for r, (d, n, w) in zip(got, sorted(want, key=lambda x: x[:2]), strict=True):
        assert (r.doc_id, r.n_ngrams) == (d, n) and (w is None) == (r.log_weight is None)
        assert w is None or abs(r.log_weight - w) < 1e-6 * (1 + abs(w)) and abs(r.key - w - noise[d]) < 1e-6 * (1 + abs(w))
        assert r.kept == (w is not None and r.key >= least)
    assert abs(least - keys[k - 1]) < 1e-6
    by_weight = sorted((r.log_weight for r in got if r.log_weight is not None), reverse=True)[k - 1]
    assert sum(r.kept != (r.log_weight >= by_weight) for r in got if r.log_weight is not None) > 5  # the noise matters


# --- 6: toxicity


def test_toxic_documents_are_found(spark, make):
    rnd = random.Random(9)
    words = ["the", "of", "river", "house", "walks", "green", "in", "stone", "you"]
    text = lambda bad: " ".join(rnd.choice(words) if rnd.random() > 0.06 * bad else rnd.choice(["zorkish", "idiot", "blarg"]) for _ in range(80))
    rows = [(i, text(i % 4 == 0)) for i in range(800)] + [(2000, None), (2001, ""), (2001, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 800)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(make(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 800]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.93


def plain_features(text, weights):
    """The features of one text, found by regular expressions; `weights` are the lexicon's words."""
    n_signs = lambda pattern, s: len(re.findall(pattern, s))
    found = re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", text)
    lowered, seeds, you = [low(w) for w in found], toxicity.INSULTS.split(), toxicity.SECOND_PERSON.split()
    weight = [max([weights.get(w, 0)] + [weights.get(w[:n], 0) for n in toxicity.BEGINNINGS if len(w) > n]) for w in lowered]
    hits = [i for i, w in enumerate(lowered) if weight[i] > 0 or w in seeds]
    yours = [i for i, w in enumerate(lowered) if w in you]
    beside = lambda k: yours[max(0, k - 1) : k + 1]
    gaps = [min((abs(i - j) for j in beside(bisect.bisect(yours, i))), default=50) for i in hits]
    tokens = WORD.findall(text)
    odd = [t for t in tokens if len(t) > 3 and re.search("[A-Za-z\u0080-\U0010ffff]", t) and re.search("[^A-Za-z\u0080-\U0010ffff]", t[1:-2] or "a")]
    plain = lambda t: low(t).translate(str.maketrans("013457@$!", "oieastasi"))
    seed_hits = sum(w in seeds for w in lowered) + sum(plain(t) in seeds or plain(t) in weights for t in odd)
    letters = max(1, sum(n_signs("[A-Za-z\u0080-\U0010ffff]", w) for w in found))
    n, size, total = max(1, len(found)), max(1, len(text)), sum(weight)
    return [
        math.log1p(len(hits)), len(hits) / n, math.log1p(total), total / n, max([0, *weight]), math.log1p(seed_hits), seed_hits / n, len(yours) / n, math.log1p(sum(g <= 5 for g in gaps)),
        min([50, *gaps]), sum(n_signs("[A-Z]", w) for w in found) / letters, sum(len(w) > 1 and n_signs("[A-Z]", w) == len(w) for w in found) / n,
        sum(n_signs("[^0-9A-Za-z]", t) for t in tokens) / size, text.count("!") / size, len(odd) / n, math.log1p(len(found)),
    ]


def test_features_equal_a_plain_computation():
    """Plain signs only, in which bytes are characters; null, empty and very long texts among them."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(12)
    some = ["you", "YOU", "idiot", "1diot", "blarg", "blargest", "river,", "stone", "OK!!", "a", "x9y9z", "st@pid!", "your", "end.", "WIN", "tr4sh"]
    text = lambda n: " ".join(rnd.choice(some) for _ in range(n))
    texts = [None, "", " ", *(text(rnd.randrange(1, 90)) for _ in range(60)), text(200_000)]
    weights = {"blarg": 2.5, "river": 0.5}
    keys = np.array([toxicity.hash_words(w)[0] for w in weights], np.uint64)
    begins = toxicity.entries(toxicity.utf8(pa.array(["blargest"]))[0], np.array([0]), np.array([8]))[1 + toxicity.BEGINNINGS.index(5)]
    lexicon = toxicity.Lexicon.of(np.concatenate([keys, begins]), np.array([2.5, 0.5, 2.5]))
    got = toxicity.features(pa.array(texts, pa.string()), lexicon)
    assert got.shape == (len(texts), toxicity.N_FEATURES)
    assert np.allclose(got, [plain_features(t or "", weights) for t in texts], atol=1e-9)


def test_toxicity_without_labels(spark, make, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(make(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and {r.score for r in got} == {0.0}
    assert toxicity.score(make([]), none).count() == 0


def test_features_do_not_see_other_columns(spark):
    from pyspark.sql import Row

    docs = spark.createDataFrame([Row(doc_id=i, text="same text", lang="en", source="a", n_chars=9) for i in range(3)])
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, labels).select("score").distinct().count() == 1
    assert docs.select(toxicity.held_out(F.col("doc_id")).alias("h")).count() == 3
