"""Alignment of the characters of two readings of one text, in time about linear in their length.

1. Windows of `k` characters that occur once in each text are anchors.  Neighbouring ones on one diagonal are a run; the heaviest
   chain of runs that rises in both texts is kept.
2. Gaps between them are aligned the same way with half of `k`, and once they are short by a longest common subsequence: its rows are
   big integers with a bit for each character, from the last of which the pairs are traced back.
3. A long gap without any anchor holds unrelated or periodic text; it is aligned piece by piece along its diagonal.
"""

from __future__ import annotations

import numpy as np

#: Characters of an anchor, and of a gap side that is aligned by a common subsequence.
ANCHOR, GAP = 16, 2048
_STEP = 0x9E3779B97F4A7C15


def _windows(text: np.ndarray, k: int) -> np.ndarray:
    h, step = np.zeros(len(text) - k + 1, np.uint64), 1
    for j in range(k):
        h += (text[j : len(text) - k + 1 + j].astype(np.uint64) + np.uint64(1)) * np.uint64(step)
        step = step * _STEP % (1 << 64)
    return h


def _once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, first, n = np.unique(h, return_index=True, return_counts=True)
    return value[n == 1], first[n == 1]


def _runs(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, characters) of the heaviest rising chain of runs of anchors."""
    if min(len(a), len(b)) < k:
        return []
    (va, pa), (vb, pb) = _once(_windows(a, k)), _once(_windows(b, k))
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    order = np.argsort(pa[ia])
    x, y = pa[ia][order], pb[ib][order]
    if not len(x):
        return []
    cells = np.arange(k)
    same = (a[x[:, None] + cells] == b[y[:, None] + cells]).all(axis=1)  # hashes are not trusted
    x, y = x[same], y[same]
    if not len(x):
        return []
    new = np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)])
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate([at, [len(x)]])) + k - 1
    xs, ys, sizes = x[at].tolist(), y[at].tolist(), size.tolist()
    rank = np.argsort(np.argsort(y[at], kind="stable"), kind="stable").tolist()
    best, n = [(0, -1)] * (len(xs) + 1), len(xs)  # best chain that ends at each rank or below it, as prefix maxima
    before, weight = [-1] * n, [0] * n
    for i in range(n):
        j, top = rank[i], (0, -1)
        while j > 0:
            top = max(top, best[j])
            j -= j & -j
        weight[i], before[i] = top[0] + sizes[i], top[1]
        j = rank[i] + 1
        while j <= n:
            best[j] = max(best[j], (weight[i], i))
            j += j & -j
    i, chain = max(range(n), key=weight.__getitem__), []
    while i >= 0:
        chain.append((xs[i], ys[i], sizes[i]))
        i = before[i]
    out, end_a, end_b = [], 0, 0
    for p, q, m in reversed(chain):
        late = max(0, end_a - p, end_b - q)
        if late < m:
            out.append((p + late, q + late, m - late))
            end_a, end_b = p + m, q + m
    return out


def _subsequence(a: np.ndarray, b: np.ndarray, to: np.ndarray, at_a: int, at_b: int) -> None:
    where: dict[int, int] = {}
    for j, c in enumerate(b.tolist()):
        where[c] = where.get(c, 0) | 1 << j
    ones = (1 << len(b)) - 1
    row, rows = ones, []
    for c in a.tolist():
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & ones
        rows.append(row)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            to[at_a + i] = at_b + j


def align(a: str, b: str, k: int = ANCHOR) -> np.ndarray:
    """For each code point of `a` the place of its partner in `b`, -1 if it has none; partners are equal and in order."""
    whole_a, whole_b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    to = np.full(len(whole_a), -1, np.int64)
    todo = [(0, len(whole_a), 0, len(whole_b), k)]
    while todo:
        a0, a1, b0, b1, k = todo.pop()
        x, y = whole_a[a0:a1], whole_b[b0:b1]
        m = min(len(x), len(y))
        if not m:
            continue
        other = np.flatnonzero(x[:m] != y[:m])
        head = int(other[0]) if len(other) else m
        other = np.flatnonzero(x[::-1][: m - head] != y[::-1][: m - head])
        tail = int(other[0]) if len(other) else m - head
        to[a0 : a0 + head] = np.arange(b0, b0 + head)
        to[a1 - tail : a1] = np.arange(b1 - tail, b1)
        a0, a1, b0, b1 = a0 + head, a1 - tail, b0 + head, b1 - tail
        x, y = whole_a[a0:a1], whole_b[b0:b1]
        if not len(x) or not len(y):
            continue
        if max(len(x), len(y)) <= GAP:
            _subsequence(x, y, to, a0, b0)
            continue
        runs = _runs(x, y, k) if k >= 2 else []
        if runs:
            end_a, end_b = a0, b0
            for p, q, size in runs:
                to[a0 + p : a0 + p + size] = np.arange(b0 + q, b0 + q + size)
                todo.append((end_a, a0 + p, end_b, b0 + q, k // 2))
                end_a, end_b = a0 + p + size, b0 + q + size
            todo.append((end_a, a1, end_b, b1, k // 2))
        elif k >= 4:
            todo.append((a0, a1, b0, b1, k // 2))
        else:
            parts = -(-max(len(x), len(y)) // GAP)
            cut = lambda low, high: [low + (high - low) * p // parts for p in range(parts + 1)]
            xs, ys = cut(a0, a1), cut(b0, b1)
            for p in range(parts):
                _subsequence(whole_a[xs[p] : xs[p + 1]], whole_b[ys[p] : ys[p + 1]], to, xs[p], ys[p])
    return to
