"""Runs of words that repeat with a period, found by block matching with Aho-Corasick automata over sequences of integers.

A *run* is a stretch of consecutive words with the smallest period q (words q apart are identical), of at least `least`
words and `times` periods, that no neighbouring word extends.  Each document is searched by itself, in one task:

1. Its words become integers.  Windows of the first block size that occur once in the text (by hash) can be in no run, so
   only stretches of windows that occur again are searched, each as a sequence of its own.
2. At scale b = 2^k the blocks that begin at multiples of b are the keys of an automaton, which is run over the stretch.
   A run of a period from b to 2b holds such a block and, one period later, its next occurrence.  Occurrences at
   other distances belong to other scales, and those inside a run of a shorter period are repetitions of that one.  The
   first scale also stands for all shorter periods, as a run has `least` words.
3. Each block and its occurrence seed an exact extension to both sides; a stretch that passes the bounds is a run, its
   smallest period the least one found for it.

Defined cases: a null or empty text has no words and no runs; repeated rows and null ids are searched each; a text of any
length is searched whole (memory grows with the words of one text); columns other than the two named are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, slices
from .textbytes import mix

LEAST, TIMES = 24, 3
_STEP = 0xD6E8FEB86659FD93


def first_block(least: int) -> int:
    """The largest power of two of which every run of a shorter period holds an aligned block and its next occurrence."""
    size = 1
    while 3 * (2 * size) - 2 <= least:
        size *= 2
    return size


def again(ids: np.ndarray, size: int) -> np.ndarray | None:
    """Whether the window of `size` words at each place occurs elsewhere too, by hash; None if no window does."""
    mixed, step = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    h = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        h += mixed[j : len(ids) - size + 1 + j] * np.uint64(step)
        step = step * _STEP % (1 << 64)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(h, twice) if len(twice) else None


def stretches(live: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the words that windows which occur again cover, where these are `least` words or more."""
    change = np.zeros(len(live) + size, np.int64)
    at = np.flatnonzero(live)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    covered = np.concatenate([[False], np.cumsum(change) > 0, [False]])
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least]


def _alike(word: np.ndarray, a: int, c: int) -> int:
    """How many words are the same from places a and c on, a before c."""
    done, step, n = 0, 32, len(word) - c
    while done < n:
        m = min(step, n - done)
        other = word[a + done : a + done + m] != word[c + done : c + done + m]
        if (k := int(other.argmax())) or other[0]:
            return done + k
        done, step = done + m, step * 2
    return n


def _alike_before(word: np.ndarray, a: int, c: int) -> int:
    """How many words are the same before places a and c, a before c."""
    done, step = 0, 32
    while done < a:
        m = min(step, a - done)
        other = (word[a - done - m : a - done] != word[c - done - m : c - done])[::-1]
        if (k := int(other.argmax())) or other[0]:
            return done + k
        done, step = done + m, step * 2
    return a


def _search(word: np.ndarray, live: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """{(begin, end): smallest period} of the runs of one stretch."""
    n, base = len(word), first_block(least)
    values, found, done = tuple(word.tolist()), {}, {}
    dead = np.concatenate([[0], np.cumsum(~live)])  # windows before each place that occur once
    size = base
    while size == base or size * times <= n:
        automaton, keys = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
        for i in range(0, n - size + 1, size):
            if dead[i + size - base + 1] == dead[i]:
                key = values[i : i + size]
                if (places := automaton.get(key, None)) is None:
                    automaton.add_word(key, [i])
                    keys += 1
                else:
                    places.append(i)
        if keys:
            reach = np.zeros(n, np.int64)  # how far a run of a shorter period goes that begins at or before each place
            if size > base and found:
                begins, ends = np.array(list(found)).T
                np.maximum.at(reach, begins, ends)
                reach = np.maximum.accumulate(reach)
            reach = reach.tolist()
            automaton.make_automaton()
            nearest = 1 if size == base else size
            for last, places in automaton.iter(values):
                at = last - size + 1
                for i in places[bisect_left(places, at - 2 * size + 1) : bisect_right(places, at - nearest)]:
                    period = at - i
                    if i < done.get(period, 0) or reach[i] >= at + size:
                        continue
                    end = at + size + _alike(word, i + size, at + size)
                    begin = i - _alike_before(word, i, at)
                    done[period] = end - period
                    if end - begin >= max(least, times * period):
                        found[begin, end] = min(period, found.get((begin, end), period))
        size *= 2
    return found


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of integers, by start and period."""
    size = first_block(least)
    if len(ids) < least or (live := again(ids, size)) is None:
        return []
    out = []
    for a, b in stretches(live, size, least):
        out += [(a + begin, end - begin, period) for (begin, end), period in _search(ids[a:b], live[a : b - size + 1], least, times).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only those of its first period and those outside of any run's rest."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words long, runs array<struct<start, length, period>>, collapsed string) of every text.

    `collapsed` is the text without the repetitions, its words joined by one space.  `times` is 3 or more.
    """
    if times < 3 or least < 1:
        raise ValueError("runs have three periods and a word at least")

    def run(batches):
        for batch in slices(batches, text_col):
            texts, counts, offsets, rows = [], [], [0], []
            for raw in batch.column(text_col).cast(pa.binary()).to_pylist():
                words = (raw or b"").split()  # bytes are split at 0x20 and 0x09 to 0x0D
                known: dict[bytes, int] = {}
                own = runs_of(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), least, times) if len(words) >= least else []
                rows += own
                offsets.append(len(rows))
                counts.append(len(words))
                texts.append(collapsed(words, own))
            fields = np.array(rows, np.int64).reshape(-1, 3).T
            struct = pa.StructArray.from_arrays([pa.array(c) for c in fields], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct), pa.array(texts, pa.binary()).cast(pa.string())],
                [id_col, "n_words", "runs", "collapsed"],
            )

    shape = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(id_col, text_col).transform(in_arrow, run, shape)
