"""URL filter: many wildcard rules simulated at once by a bit-parallel automaton.

Every rule is a glob over a canonical URL (see `canonical`): `**` stands for any run of bytes, `*` for any run without
`/`, `?` for one character other than `/`; all else, and what follows a backslash, stands for itself.  A rule of m symbols is a chain of m + 1 states;
wildcards are loops on a state, so no empty moves are needed.  The chains of all rules are packed one after another
into words of 64 bits.  One step for a byte c is the extended Shift-And

    D = ((D << 1) & B[c]) | (D & L[c])

over all words with the carry between them, where B[c] has the states that are entered by c and L[c] the states that
loop on c.  A batch of URLs is run side by side, one byte position at a time.

Defined cases: a null URL or one without `://` has the empty canonical form, which only a rule of wildcards matches;
repeated rows are judged each; columns other than the two named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, _A_TO_Z, _A_TO_Z.lower())


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """`.host/path`, so that a host and its subdomains share the ending `.host`; empty if both are."""
    return F.when((host == "") & (path == ""), F.lit("")).otherwise(F.concat(F.lit("."), host, path))


@dataclass(frozen=True)
class Rule:
    """A glob over the canonical form; `name` and `verdict` are what a match returns."""

    glob: str
    verdict: str
    name: str | None = None

    @staticmethod
    def prefix(host: str, path: str, verdict: str) -> Rule:
        """A rule for a host with all its subdomains and the paths that start with `path`."""
        literal = re.sub(r"([\\*?])", r"\\\1", host + path)
        return Rule(f"*.{literal}**", verdict, host + path)


def as_regex(glob: str) -> str:
    """The same pattern as a regular expression for whole canonical URLs, for engines that have no globs."""
    parts = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    return "".join(parts.get(t) or re.escape(t[-1]) for t in re.findall(r"(?s)\\.|\*\*|.", glob))


class Automaton:
    """The packed masks of a list of globs; `matches` gives the states' accept bits by URL."""

    def __init__(self, globs: Sequence[str]):
        entered, loops, first, last, at = [], [], [], [], 0
        any_byte, segment, follow = np.ones(256, bool), np.ones(256, bool), np.zeros(256, bool)
        segment[ord("/")] = False
        follow[0x80:0xC0] = True
        for glob in globs:
            entered.append(np.zeros(256, bool))
            loops.append(np.zeros(256, bool))
            first.append(at)
            text, i = glob.encode(), 0
            while i < len(text):
                if text[i : i + 2] == b"**":
                    loops[-1] |= any_byte
                    i += 2
                    continue
                if text[i : i + 1] == b"*":
                    loops[-1] |= segment
                else:
                    question = text[i : i + 1] == b"?"
                    i += text[i : i + 1] == b"\\" and i + 1 < len(text)
                    one = np.zeros(256, bool)
                    one[text[i]] = True
                    entered.append(segment & ~follow if question else one)
                    loops.append(follow.copy() if question else np.zeros(256, bool))
                i += 1
            at = len(entered)
            last.append(at - 1)
        self.words = max(1, -(-at // 64))
        self.enter, self.loop = self._pack(np.array(entered).T), self._pack(np.array(loops).T)
        start = np.zeros((1, at), bool)
        start[0, first] = True
        self.start = self._pack(start)[0]
        self.word, self.bit = np.array(last) // 64, (np.array(last) % 64).astype(np.uint64)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), np.uint64)
        wide[:, : bits.shape[1]] = bits
        return (wide.reshape(len(bits), self.words, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)

    def matches(self, urls: Sequence[str]) -> np.ndarray:
        """Boolean (url, glob): whether the glob matches the whole URL."""
        raw = [(url or "").encode() for url in urls]
        length = np.array([len(x) for x in raw], np.int64)
        begin = np.concatenate([[0], np.cumsum(length)])[:-1]
        data = np.frombuffer(b"".join(raw), np.uint8)
        state = np.tile(self.start, (len(raw), 1))
        order = np.argsort(-length, kind="stable")
        ended = np.sort(length)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(length.max(initial=0))):
            live = order[: len(raw) - int(np.searchsorted(ended, step, "right"))]
            byte, d = data[begin[live] + step], state[live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[live] = (moved & self.enter[byte]) | (d & self.loop[byte])
        return (state[:, self.word] >> self.bit & one).astype(bool)


def judge(pages: DataFrame, rules: Sequence[Rule], default: str, extra: Sequence[Rule] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every URL.

    The longest matching rule of `rules` by name wins, ties to the earlier one.  Where none matches, `rule` is null and
    the verdict is that of the first matching rule of `extra`, else `default`.
    """
    ordered = [*sorted(rules, key=lambda r: -len(r.name or r.glob)), *extra]
    named, verdicts = len(rules), [r.verdict for r in ordered] + [default]
    names = [r.name if i < named else None for i, r in enumerate(ordered)] + [None]
    machine = Automaton([r.glob for r in ordered])

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def run(url: pd.Series) -> pd.DataFrame:
        hit = machine.matches(url.tolist())
        best = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ordered))
        return pd.DataFrame({"rule": [names[i] for i in best], "verdict": [verdicts[i] for i in best]})

    split = pages.select(id_col, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = split.withColumn("judged", run(canonical(F.col("host"), F.col("path"))))
    return judged.select(id_col, "host", "path", "judged.rule", "judged.verdict")
