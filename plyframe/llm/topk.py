"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments, coarse (few long segments) to fine (many short ones).  With mean m and deviation s of a
segment of length L, the squared distance of two vectors is at least the sum of L * ((m - m')^2 + (s - s')^2), so their
inner product is at most the sum of L * (m m' + s s').  A group of like queries (those whose coarse means agree in sign) meets
tiles of like candidates, the most promising tile first.  At each level the bounds of a tile are one matrix product of the
statistics; pairs whose bound is below the query's floor are dropped, and exact products are computed for the survivors only.
Bounds are widened by a rounding margin, so results are exact.  A query's floor is its k-th best score so far; it begins with
the k-th best among `floor_rows` candidates drawn by hash, which all tasks share.

Every pair of a chunk of queries and a bucket of candidates is one task's work; the tasks' k best are merged by query.

Defined cases: see `vectors`; a query's own id is no candidate; repeated rows count once; with fewer candidates than k
all are returned.  Scores are exact 64-bit integers; a score beyond their range is an error, not a rounded number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, compared, matrices, merge, usable

LEVELS = (4, 16, 32)
TILE, GROUP = 512, 64


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * (mean, deviation) of each segment: the product of two rows bounds their inner product from above."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    length = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / length
    spread = np.maximum(np.add.reduceat(x * x, cuts[:-1], axis=1) / length - mean * mean, 0)
    return np.concatenate([mean * np.sqrt(length), np.sqrt(spread * length)], axis=1)


def products(q: np.ndarray, c: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs `wanted`, exactly: by doubles, 64-bit or unbounded integers, as their size asks for."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 2**53:
        return (q @ c.T).astype(np.int64)
    if largest < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    exact = np.where(wanted, whole(q) @ whole(c).T, 0)
    if exact.size and not (-(2**63) < exact.min() and exact.max() < 2**63):
        raise OverflowError("an inner product does not fit into a long")
    return exact.astype(np.int64)


def worthwhile(levels: Sequence[int], width: int) -> list[int]:
    """The levels whose bounds, of two numbers a segment, cost at most half of an exact product; at least the coarsest."""
    fine = [s for s in levels if 4 * s <= width]
    return fine or list(levels[:1])


def alike(stat: np.ndarray) -> np.ndarray:
    """An order in which vectors whose coarse means agree in sign, then those of like size, stand together."""
    means = stat[:, : stat.shape[1] // 2]
    signs = (means[:, :16] > 0) @ (1 << np.arange(min(16, means.shape[1])))
    return np.lexsort((np.linalg.norm(stat, axis=1), signs))


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels: Sequence[int] = LEVELS, floor: np.ndarray | None = None) -> tuple[Best, int]:
    """(the best candidates of each query in one bucket, the number of exact products that took)."""
    best, done = Best(len(q_ids), k, np.int64, floor), 0
    levels = worthwhile(levels, q.shape[1]) if levels else []
    margin = 1e-9 * (1 + np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1])
    coarse = statistics(c, levels[0]) if levels else np.zeros((len(c), 2))
    order = alike(coarse)
    c_ids, c = c_ids[order], c[order]
    tiles = [slice(at, at + TILE) for at in range(0, len(c), TILE)]
    c_stat = [statistics(c, s) for s in levels]
    q_stat = [statistics(q, s) for s in levels]
    asked = alike(q_stat[0]) if levels else np.arange(len(q))
    for group in (asked[at : at + GROUP] for at in range(0, len(asked), GROUP)):
        first = q_stat[0][group] @ c_stat[0].T + margin if levels else None
        promise = [first[:, t].max() for t in tiles] if levels else range(len(tiles), 0, -1)
        for t in (tiles[i] for i in np.argsort(promise)[::-1]):
            alive = q_ids[group][:, None] != c_ids[t][None, :]
            known = (best.floor[group] > best.none)[:, None]
            for at, (mine, theirs) in enumerate(zip(q_stat, c_stat, strict=True)):
                cols = np.flatnonzero(alive.any(axis=0))
                if not known.any() or not len(cols):
                    break
                bound = first[:, t][:, cols] if at == 0 else mine[group] @ theirs[t][cols].T + margin
                alive[:, cols] &= ~known | (bound >= best.floor[group][:, None])
            rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if len(cols):
                wanted = alive[np.ix_(rows, cols)]
                score = np.where(wanted, products(q[group[rows]], c[t][cols], wanted), best.none)
                done += score.size
                best.add(score, c_ids[t][cols], group[rows])
    return best, done


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, levels: Sequence[int] = LEVELS, floor_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long) for floor(scale * x) of every component x."""
    whole = lambda x: np.floor(scale * x)
    candidates, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    n = max(1, candidates.count())
    drawn = candidates.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < floor_rows).limit(2 * floor_rows).toArrow()
    sample: dict[int, list] = {}
    for batch in drawn.combine_chunks().to_batches():
        for ids, x in matrices(batch):
            sample.setdefault(x.shape[1], []).append((ids, whole(x)))
    shared = candidates.sparkSession.sparkContext.broadcast(sample)  # at most 2 * floor_rows vectors

    def floors(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        best = Best(len(ids), k, np.int64)
        for c_ids, c in shared.value.get(x.shape[1], []):
            other = ids[:, None] != c_ids[None, :]
            best.add(np.where(other, products(x, c, other), best.none), c_ids)
        return best.floor

    found = compared(candidates, asked, lambda q_ids, q, floor, c_ids, c: search(q_ids, q, c_ids, c, k, levels, floor)[0], "long", whole, floors)
    return merge(found, k)
