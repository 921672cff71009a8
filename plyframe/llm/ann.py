"""Approximate nearest neighbours by cosine: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks of the residuals' parts are fitted on a bounded sample (`sample` rows, by hash of
the id); every row is indexed: it goes to its nearest centroid's list with the codes of its residual.  A query probes the
lists whose centroids are nearest and scores their rows by tables of products of its parts with the codewords (asymmetric:
the query is not quantised).  Only codes travel to the queries.  Of all probed rows those are reranked whose quantised score is
at most `margin` below the query's (k + 1)th best one: their vectors are fetched by row number, and their exact cosines in
doubles decide.  Each piece of a list sends only rows that can still be among them, by its own best scores and by those
of the sample's rows.

Two numbers are fitted on the sample: the lists to probe, the fewest that hold `hold` of the true neighbours of 200 of its rows, and the
margin, the least that keeps `hold` of them.  Where there are more rows than the sample, a quarter of it has no part in the fit
of the codes and sets the margin, as codes fit the rows they come from better than others.  Equal vectors are one row of the index.
Lists are split by hash into pieces of about `piece` rows, and where more than `chunk` queries probe a list these are split too, so one
list may hold any share of all rows and be probed by all queries.

Defined cases: see `vectors`; zero vectors take no part; a query's own id is no candidate; repeated rows count once;
with fewer candidates than k all are returned (a small table is one list).  The index holds the vectors of the most frequent
length; those of other lengths are searched without one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_arrow, small
from .vectors import Best, compared, matrices, merge, usable


#: Rows of a product with all centres, and queries of a product with all rows of a piece or of the sample.
ROWS, QUERIES = 2048, 256


@dataclass(frozen=True)
class Model:
    """Unit centroids (lists, d), codebooks (parts, codes, d / parts), lists to probe, margin of scores, lists and codes of the sample."""

    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int = 1
    margin: float = 0.0
    known: tuple[np.ndarray, np.ndarray] | None = None

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + ROWS] @ self.centroids.T).argmax(axis=1) for i in range(0, len(x), ROWS)]])

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest, width = x - self.centroids[lists], self.codebooks.shape[2]
        return np.stack([_nearest(rest[:, p * width : (p + 1) * width], book) for p, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def near(self, q: np.ndarray) -> np.ndarray:
        """The lists that each unit query probes."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]

    def scores(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """[query, row] quantised scores: the list's product and those of the row's codewords, by table."""
        parts, _, width = self.codebooks.shape
        tables = np.einsum("qpw,pcw->qpc", q.reshape(len(q), parts, width), self.codebooks)
        out = (q @ self.centroids.T)[:, lists]
        for p in range(parts):
            out += tables[:, p, :][:, codes[:, p]]
        return out

    def floors(self, q: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
        """A score that k + 1 rows of the lists that each query probes reach, by the sample's rows; -inf if there are fewer."""
        lists, codes = self.known
        if len(lists) <= k:
            return np.full(len(q), -np.inf)
        probed = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(probed, near, True, axis=1)
        return np.partition(np.where(probed[:, lists], self.scores(q, lists, codes), -np.inf), -k - 1, axis=1)[:, -k - 1]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres * centres).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *[(size - 2 * (x[i : i + ROWS] @ centres.T)).argmin(axis=1) for i in range(0, len(x), ROWS)]])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's centres of a sample in memory; an empty cell keeps its centre."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def fit(x: np.ndarray, lists: int, parts: int, k: int, hold: float, whole: bool = True, seed: int = 7) -> Model:
    """The model of a sample of unit vectors; `whole` if there are no other rows."""
    rng = np.random.default_rng(seed)
    kept = np.ones(len(x), bool)
    if not whole and len(x) >= 64:
        kept[rng.choice(len(x), len(x) // 4, replace=False)] = False
    centres = kmeans(x[kept], lists, rng)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    own, width = Model(centres, np.zeros((0, 0, 0))).assign(x), x.shape[1] // parts
    rest = (x - centres[own])[kept]
    model = Model(centres, np.stack([kmeans(rest[:, p * width : (p + 1) * width], 256, rng, 8) for p in range(parts)]))
    codes = model.encode(x, own)
    asked = rng.choice(len(x), min(200, len(x)), replace=False)
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -np.inf
    place = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[np.argsort(-exact, axis=1)[:, :k]], axis=1).ravel()) + 1
    probes = max(1, min(lists, int(_held(needed, hold, lists))))
    tried = np.ones(len(x), bool) if kept.all() else ~kept
    about = model.scores(x[asked], own, codes)
    about[np.arange(len(asked)), asked] = -np.inf
    exact, about = exact[:, tried], about[:, tried]
    margin = np.inf  # too few rows to say
    if tried.sum() > k + 1:
        true = np.argsort(-exact, axis=1)[:, :k]
        last = np.partition(about, -k - 1, axis=1)[:, -k - 1]
        below = np.sort((last[:, None] - np.take_along_axis(about, true, axis=1)).ravel())
        margin = max(0.0, float(_held(below, hold, 0.0)))
    return Model(centres, model.codebooks, probes, margin, (own, codes))


def _held(ordered: np.ndarray, hold: float, none: float) -> float:
    """The value that the share `hold` of ordered values does not exceed."""
    return ordered[min(len(ordered) - 1, max(0, int(np.ceil(hold * len(ordered))) - 1))] if len(ordered) else none


def pieces_and_chunks(filed: DataFrame, probes: DataFrame, piece: int, chunk: int) -> DataFrame:
    """(list, pieces, chunks): into how many parts the rows of a list and the queries that probe it are split; a row per list."""
    rows = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
    asked = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    return durable(rows.join(asked, "list"))


def search(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
    lists: int | None = None, parts: int = 16, sample: int = 20_000, hold: float = 0.99, piece: int = 4096, chunk: int = 1024,
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the k nearest found, score the exact cosine.

    lists: centroids; by default sqrt(rows) / 4, at most 4096, one list for fewer than 256 rows.
    """
    some = lambda df: usable(df, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    rows, asked = some(vectors), some(queries)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if not lengths:
        return merge(rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")), k)
    usual, n = lengths[0]["d"], lengths[0]["count"]
    found = indexed(rows.where(F.size("v") == usual), asked.where(F.size("v") == usual), n, k, lists, parts, sample, hold, piece, chunk)
    if len(lengths) > 1:  # vectors of other lengths have no index: they are compared one by one
        found = found.unionByName(compared(rows.where(F.size("v") != usual), asked.where(F.size("v") != usual), lambda q_ids, q, _, c_ids, c: cosines(q_ids, q, c_ids, c, k), "double"))
    return merge(found, k)


def cosines(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Best:
    """The k nearest of each query in one bucket, without an index."""
    best, length = Best(len(q), k), np.linalg.norm(c, axis=1)
    for at in range(len(q)):
        score = (c * q[at]).sum(axis=1) / (length * np.linalg.norm(q[at]))
        best.add(np.where(c_ids == q_ids[at], -np.inf, score)[None, :], c_ids, np.array([at]))
    return best


def indexed(rows: DataFrame, asked: DataFrame, n: int, k: int, lists: int | None, parts: int, sample: int, hold: float, piece: int, chunk: int) -> DataFrame:
    """(query_id, vec_id, score) of what is reranked for each query; all vectors have one length."""
    lists = lists or (1 if n < 256 else min(4096, max(2, round(n**0.5 / 4))))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(n, 1))) < sample).limit(2 * sample).toPandas().sort_values("vec_id")
    if not len(drawn):  # ids whose hashes all lie above the sample's
        drawn = rows.orderBy("vec_id").limit(sample).toPandas()
    x = unit(np.stack(drawn["v"].tolist()))
    parts = next(p for p in range(min(parts, x.shape[1]), 0, -1) if x.shape[1] % p == 0)
    model = rows.sparkSession.sparkContext.broadcast(fit(x, lists, parts, k, hold, len(x) >= n))
    # equal vectors are one row of the index, with the k + 1 smallest of their ids: no others can be among the k nearest
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    once = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    once = durable(once.select(F.monotonically_increasing_id().alias("row"), "v", "ids"))

    def index(batches):
        for batch in batches:
            for number, v in matrices(batch, ("row",)):
                own = model.value.assign(unit(v))
                codes = model.value.encode(unit(v), own)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(number), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "row", "codes"])

    def probe(batches):
        for batch in batches:
            for ids, v in matrices(batch):
                for i in range(0, len(ids), QUERIES):
                    q = unit(v[i : i + QUERIES])
                    near = model.value.near(q)
                    floor = model.value.floors(q, near, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())), pa.array(ids[i : i + QUERIES]), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(floor)], ["lists", "query_id", "q", "floor"]
                    )

    filed = durable(in_arrow(once.select("row", "v"), index, "list int, row long, codes binary"))
    probes = durable(in_arrow(asked, probe, "lists array<int>, query_id long, q binary, floor double"))
    probes = probes.withColumn("list", F.explode("lists")).drop("lists")
    split = F.broadcast(pieces_and_chunks(filed, probes, piece, chunk))  # a row per list, at most 4096 by default
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    spread = lambda value, count: F.pmod(F.xxhash64(value), F.col(count)).cast("int")
    left = filed.join(split, "list").withColumn("piece", spread("row", "pieces")).withColumn("chunk", every("chunks")).drop("pieces", "chunks")
    right = probes.join(split, "list").withColumn("chunk", spread("query_id", "chunks")).withColumn("piece", every("pieces")).drop("pieces", "chunks")

    def about(key, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "about": np.zeros(0)})]
        if len(c) and len(q):
            codes, number, ids = np.stack([np.frombuffer(v, np.uint8) for v in c["codes"]]), c["row"].to_numpy(), q["query_id"].to_numpy()
            for at in range(0, len(q), QUERIES):  # so many queries at once keep the scores of a piece at some megabytes
                part = q.iloc[at : at + QUERIES]
                score = model.value.scores(np.stack([np.frombuffer(v) for v in part["q"]]), np.full(len(c), key[0]), codes)
                least = part["floor"].to_numpy()
                if len(c) > k + 1:
                    least = np.maximum(least, np.partition(score, -k - 1, axis=1)[:, -k - 1])
                i, j = np.nonzero(score >= (least - model.value.margin)[:, None])
                out.append(pd.DataFrame({"query_id": ids[at + i], "row": number[j], "about": score[i, j]}))
        return pd.concat(out)

    keys = ("list", "piece", "chunk")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(about, "query_id long, row long, about double")
    last = F.nth_value("about", k + 1).over(Window.partitionBy("query_id").orderBy(F.desc("about")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left_over = durable(near.withColumn("last", last).where(F.col("last").isNull() | (F.col("about") >= F.col("last") - F.lit(model.value.margin))).select("query_id", "row"))
    fetched = once.join(small(left_over), "row").select("query_id", "ids", F.col("v").alias("c")).join(asked.select(F.col("vec_id").alias("query_id"), "v"), "query_id")

    def exact(batches):
        for batch in batches:
            for c, q_ids, ids, v in matrices(batch, ("c", "query_id", "ids")):
                c = np.stack(c) if len(c) else np.zeros((0, v.shape[1]))
                # by pair, not as one matrix product: equal rows then score equally, wherever they stand
                score = (c * v).sum(axis=1) / (np.linalg.norm(c, axis=1) * np.linalg.norm(v, axis=1))
                times = np.array([len(i) for i in ids], np.int64)
                rows = np.repeat(q_ids, times), np.concatenate([np.zeros(0, np.int64), *ids]), np.repeat(score, times)
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["query_id", "vec_id", "score"])

    return in_arrow(fetched, exact, "query_id long, vec_id long, score double").where(F.col("query_id") != F.col("vec_id"))
