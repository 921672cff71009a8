"""Characters of two readings: valid pairs, as many as a plain computation finds, in linear time."""

import difflib
import random
import time

import pytest

from plyframe.functions import align as A
from plyframe.operators import alignment as L


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def valid(a, b, to):
    pairs = [(i, int(j)) for i, j in enumerate(to) if j >= 0]
    return len(to) == len(a) and all(a[i] == b[j] for i, j in pairs) and all(p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_short_texts_have_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc♕😀"[: rng.choice([2, 3, 5])]) for _ in range(rng.randrange(25))) for _ in range(2))
        to = A.align(a, b)
        assert valid(a, b, to) and sum(to >= 0) == longest(a, b), (a, b)


def noisy(rng, text, rate):
    out = []
    for c in text:
        kind = rng.random() / rate
        out.append("" if kind < 0.3 else rng.choice("xyz ") + c if kind < 0.6 else rng.choice("xyz") if kind < 1 else c)
    return "".join(out)


@pytest.mark.parametrize("gap", [2048, 12])
def test_noisy_copies_align_at_least_as_well_as_longest_blocks(monkeypatch, gap):
    monkeypatch.setattr(A, "GAP", gap)
    rng = random.Random(6)
    for rate in (0.0, 0.02, 0.1, 0.3):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
        a = " ".join(rng.choice(words) for _ in range(150))
        b = noisy(rng, a, rate) if rate else a
        to = A.align(a, b)
        blocks = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert valid(a, b, to) and sum(to >= 0) >= (0.98 if gap > 100 else 0.9) * blocks


def test_a_moved_paragraph_and_periodic_texts():
    a, b = "p" * 5000 + "q" * 3000, "p" * 4000 + "q" * 6000
    assert valid(a, b, A.align(a, b)) and sum(A.align(a, b) >= 0) == 7000
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcdef ") for _ in range(3000)) for _ in range(3)]
    to = A.align("".join(parts), parts[1] + parts[0] + parts[2])
    assert valid("".join(parts), parts[1] + parts[0] + parts[2], to) and sum(to >= 0) >= 6000
    other = "".join(rng.choice("uvwxyz") for _ in range(9000))
    assert sum(A.align("".join(parts), other) >= 0) == 0


def test_a_megabyte_takes_seconds():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    a = " ".join(rng.choice(words) for _ in range(170_000))
    b = noisy(rng, a, 0.02)
    assert len(a) > 900_000
    began = time.perf_counter()
    to = A.align(a, b)
    assert time.perf_counter() - began < 30 and valid(a, b, to) and sum(to >= 0) > 0.975 * len(a)
    began = time.perf_counter()
    assert sum(A.align("ab" * 300_000, "ba" * 300_000) >= 0) > 590_000 and time.perf_counter() - began < 30


def test_rects_of_spans_on_two_lines(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    pieces = spark.createDataFrame(
        [(1, 0, 0, "12. Te1-", (0.0, 0.0, 80.0, 20.0)), (1, 1, 1, "e8", (0.0, 30.0, 20.0, 50.0)), (1, 1, 2, "+! ", (20.0, 30.0, 50.0, 50.0)), (1, 2, 3, "elsewhere", (500.0, 0.0, 600.0, 20.0)), (1, 3, 4, "", (0.0, 60.0, 5.0, 80.0))],
        f"page int, line int, seq int, text string, bbox {box}",
    )
    blocks = spark.createDataFrame(
        [(1, 0, "12. Te1-e8+!\nnot read at all", [(4, 12), (13, 27), (4, 4), (0, 3)], (0.0, 0.0, 100.0, 60.0)), (2, 0, "abc", [(0, 3)], (0.0, 0.0, 9.0, 9.0))], f"page int, ord int, text string, spans array<struct<s: int, e: int>>, bbox {box}"
    )
    lines = L.printed_lines(pieces)
    assert {r.line for r in lines.collect()} == {0, 1, 2}
    streams = L.block_streams(lines, blocks)
    assert [(r.stream, len(r.chars)) for r in streams.collect()] == [("12. Te1- e8+!  ", 15)]
    got = {(r.page, r.span): (round(r.share, 2), r.rects) for r in L.span_rects(blocks, streams).collect()}
    assert got[1, 0] == (1.0, [[38, -2, 44, 24], [-2, 28, 44, 24]]) and got[1, 2] == (0.0, None) and got[1, 3] == (1.0, [[-2, -2, 34, 24]])
    assert got[1, 1][0] < 0.6 and got[1, 1][1] is None and got[2, 0] == (0.0, None)
