"""Blocks of vectors, and the merge of block results, for the two vector searches.

Vectors that are null, empty, hold null or non-finite components or lack an id take no part.  A vector meets only vectors of its
own length, as products of others have no meaning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow

BLOCK = "d int, n int, ids binary, data binary, floor binary"
#: Vectors of a packed block, and of the bucket or chunk that a task holds.
PACKED, BUCKET = 2048, 8192


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of the vectors that take part, repeated rows once."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(~bad & (F.size("v") > 0)).distinct()


def matrices(batch: pa.RecordBatch, columns: tuple[str, ...] = ("vec_id",)):
    """(other columns..., vectors) of a batch of rows with vectors `v`, once for each length that occurs."""
    v = batch.column("v")
    lengths = v.value_lengths().to_numpy()
    for d in np.unique(lengths):
        own = batch if (lengths == d).all() else batch.take(pa.array(np.flatnonzero(lengths == d)))
        yield *(np.asarray(own.column(c)) for c in columns), own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def blocks(rows: DataFrame, size: int, prepare=lambda x: x, floors=None) -> DataFrame:
    """The rows packed, partition by partition, into blocks of up to `size` vectors of one length; no shuffle.

    floors(ids, vectors), if given, says of each vector as a query below which score no candidate counts.
    """

    def packed(d: int, held: list) -> pa.RecordBatch:
        ids, x = (np.concatenate(y) for y in zip(*held, strict=True))
        floor = np.zeros(0) if floors is None else floors(ids, x)
        row = {"d": [d], "n": [len(ids)], "ids": [ids.tobytes()], "data": [np.ascontiguousarray(x).tobytes()], "floor": [floor.tobytes()]}
        return pa.RecordBatch.from_pydict(row, pa.schema([("d", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("floor", pa.binary())]))

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for ids, x in matrices(batch):
                own = held.setdefault(x.shape[1], [])
                room = size - sum(len(i) for i, _ in own)
                for a, b in zip([0, *range(room, len(ids), size)], [*range(room, len(ids), size), len(ids)], strict=True):
                    own.append((ids[a:b], prepare(x[a:b])))
                    if sum(len(i) for i, _ in own) == size:
                        yield packed(x.shape[1], own)
                        own.clear()
        for d, own in held.items():
            if own:
                yield packed(d, own)

    return in_arrow(rows.select("vec_id", "v"), run, BLOCK)


def unpack(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a pandas frame of blocks of one length."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in frame["ids"]])
    return ids, np.concatenate([np.frombuffer(x).reshape(n, -1) for x, n in zip(frame["data"], frame["n"], strict=True)])


def compared(candidates: DataFrame, asked: DataFrame, search: Callable, score: str, prepare=lambda x: x, floors=None) -> DataFrame:
    """(query_id, vec_id, score) that `search(q_ids, q, floor, c_ids, c)` finds between every chunk of queries and bucket of candidates.

    A pair of chunk and bucket, both of a bounded number of vectors, is one task's work.  `search` returns a `Best`.
    """
    n, m = max(1, -(-candidates.count() // BUCKET)), max(1, -(-asked.count() // BUCKET))
    spread = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = blocks(candidates, PACKED, prepare).withColumn("bucket", spread(n)).withColumn("chunk", every(m))
    right = blocks(asked, PACKED // 4, prepare, floors).withColumn("chunk", spread(m)).withColumn("bucket", every(n))
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.float64 if score == "double" else np.int64)})

    def run(key, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return empty
        c_ids, x = unpack(c)
        out = [empty]
        for at in range(len(q)):
            one = q.iloc[at : at + 1]
            q_ids, asked_v = unpack(one)
            floor = np.frombuffer(one["floor"].iloc[0], empty["score"].dtype)
            best = search(q_ids, asked_v, floor, c_ids, x)
            out.append(pd.DataFrame({"query_id": q_ids[best.row], "vec_id": best.id, "score": best.score}))
        return pd.concat(out)

    keys = ("d", "bucket", "chunk")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"query_id long, vec_id long, score {score}")


class Best:
    """The k highest (score, then smallest id) of each of some queries, fed tile by tile.  Scores are doubles or longs.

    A query may begin with a floor, a score that k candidates are known to reach.
    """

    def __init__(self, queries: int, k: int, kind: type = np.float64, floor: np.ndarray | None = None):
        self.k, self.none = k, -np.inf if kind is np.float64 else np.iinfo(kind).min
        self.floor = floor.copy() if floor is not None and len(floor) else np.full(queries, self.none, kind)
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """scores: (query, candidate), `none` where a candidate takes no part; `queries` are those of its rows, all by default."""
        queries = np.arange(len(self.floor)) if queries is None else queries
        if scores.shape[1] > self.k and len(np.unique(ids)) == len(ids):  # repeats would fill the k places of the cut
            cut = np.maximum(self.floor[queries], np.partition(scores, -self.k, axis=1)[:, -self.k])
        else:
            cut = self.floor[queries]
        row, col = np.nonzero((scores >= cut[:, None]) & (scores > self.none))
        if not len(row):
            return
        row, score, own = np.concatenate([self.row, queries[row]]), np.concatenate([self.score, scores[row, col]]), np.concatenate([self.id, ids[col]])
        order = np.lexsort((own, -score, row))
        row, score, own = row[order], score[order], own[order]
        fresh = np.ones(len(row), bool)  # a row that is repeated counts once
        fresh[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (own[1:] != own[:-1])
        row, score, own = row[fresh], score[fresh], own[fresh]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.score, self.id = row[keep], score[keep], own[keep]
        last = rank == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])


def merge(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query over all blocks, repeated rows once."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best))
    return rows.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
