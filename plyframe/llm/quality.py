"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (runs of letters and runs of other signs, and pairs of neighbours, as they are
written), one of target text and one of raw text, are bags of `2^bits` buckets.  The raw model counts all documents; the
target model counts the documents of a bounded, documented sample of labelled rows (`label_rows`, by hash of the id) that
are labelled good.  A document's log weight is the sum over its n-grams of log p_target - log p_raw, less a constant
`cut` per n-gram; the constant is fitted on a part of the labelled sample that the target model has not seen, so that a
positive weight means "likelier to be labelled good", with a rejected good document as costly as `clean_cost` kept bad ones.
The log odds of the two labels are added once for each document.  Documents are then drawn without replacement, with chances
in proportion to their weights, by Gumbel top-k: the k highest of log weight + Gumbel noise stay, where the noise is a
hash of the id (reruns agree).  k is `share` of the documents with n-grams; by default the share whose weight is positive.
Weights of long texts lie far apart, so the noise decides among short ones and among those near the bound; a `temperature`
above 1 draws more evenly.

Defined cases: a text without n-grams (null, empty, blank) has no weight and is never drawn; rows with equal keys (such
as repeated rows) are kept or rejected alike; without labels of both kinds the cut is 0; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, in_arrow, slices, unnamed
from .textbytes import BLANK, mix, utf8, words

_KINDS = np.full(256, 2, np.uint8)
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[BLANK] = 0
_PAIR = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Model:
    """log p_target - log p_raw of each bucket, the constant taken off for each n-gram, and the log prior odds."""

    ratio: np.ndarray
    cut: float = 0.0
    prior: float = 0.0


def ngrams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, text of each): the tokens, then the pairs of neighbours."""
    data, offsets = utf8(column)
    token, first = words(data, offsets, lower=False, kinds=_KINDS)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[1:] == text[:-1]
    pair = mix(token[:-1] + token[1:] * _PAIR)[inside]
    shift = np.uint64(64 - bits)
    return (np.concatenate([token, pair]) >> shift).astype(np.int64), np.concatenate([text, text[1:][inside]])


def counts(docs: DataFrame, bits: int, text_col: str, target_col: str) -> np.ndarray:
    """(2, buckets): n-grams of all documents and of those with target_col.  The result has a fixed size."""

    def run(batches):
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in slices(batches, text_col):
            bucket, text = ngrams(batch.column(text_col), bits)
            wanted = np.asarray(batch.column(target_col).fill_null(False).to_numpy(zero_copy_only=False), bool)
            total[0] += np.bincount(bucket, minlength=1 << bits)
            total[1] += np.bincount(bucket[wanted[text]], minlength=1 << bits)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    parts = docs.select(text_col, target_col).transform(in_arrow, run, "bucket long, raw long, target long")
    out = np.zeros((2, 1 << bits), np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas().itertuples():
        out[:, row.bucket] = row.raw, row.target
    return out


def labelled(labels: DataFrame, rows: int, id_col: str, label_col: str) -> DataFrame:
    """About `rows` labelled ids at most, by hash: (id, good, fits), where fits marks the seven tenths of the target model."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.min(label_col) > 0).alias("good"))
    n = max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(n)) < rows)
    return drawn.withColumn("fits", F.pmod(F.xxhash64(F.col(id_col), F.lit(13)), F.lit(10)) < 7)


def weigh(docs: DataFrame, model: Model, keep: list[str], text_col: str, temperature: float, id_col: str, seed: int) -> DataFrame:
    """(keep..., n_ngrams long, ratio double: the uncut sum, log_weight double, key double) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(len(model.ratio)).bit_length() - 1
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "n_ngrams long, ratio double"

    def run(batches):
        for batch in slices(batches, text_col):
            bucket, text = ngrams(batch.column(text_col), bits)
            size = np.bincount(text, minlength=batch.num_rows)
            total = np.bincount(text, shared.value.ratio[bucket], minlength=batch.num_rows).astype(np.float64)  # integers if there are no n-grams
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(size.astype(np.int64)), pa.array(total)], [*keep, "n_ngrams", "ratio"])

    uniform = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = F.when(F.col("n_ngrams") > 0, F.col("ratio") - F.lit(model.cut) * F.col("n_ngrams") + F.lit(model.prior))
    rows = docs.select(*dict.fromkeys([*keep, text_col])).transform(in_arrow, run, schema)
    return rows.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(uniform)))


def fit(docs: DataFrame, labels: DataFrame, bits: int = 16, label_rows: int = 40_000, clean_cost: float = 3.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of a corpus and its labels."""
    known = F.broadcast(labelled(labels, label_rows, id_col, label_col))  # at most about label_rows rows
    marked = docs.select(id_col, text_col).join(known, id_col, "left").withColumn("target", F.col("good") & F.col("fits"))
    raw, target = counts(marked, bits, text_col, "target")
    share = lambda x: np.log((x + 0.5) / (x.sum() + 0.5 * len(x)))
    plain = Model(share(target) - share(raw))
    unseen = docs.select(id_col, text_col).join(known.where(~F.col("fits")), id_col)
    scored = weigh(unseen, plain, ["good"], text_col, 0.0, "good", 0).where(F.col("n_ngrams") > 0)
    step = 1 / 256
    bins = scored.groupBy(F.floor(F.col("ratio") / F.col("n_ngrams") / F.lit(step)).alias("bin"), "good").count().toPandas()
    good, bad = (int(bins.loc[bins["good"] == kind, "count"].sum()) for kind in (True, False))
    prior = float(np.log(good / bad)) if good and bad else 0.0
    return Model(plain.ratio, best_cut(bins, clean_cost) * step, prior)


def best_cut(bins, clean_cost: float) -> float:
    """The middle of the cheapest cuts of a histogram (bin, good, count), in bins; 0 without rows of both kinds."""
    if bins["good"].nunique() < 2:
        return 0.0
    bins = bins.sort_values("bin")
    edges = np.arange(bins["bin"].min(), bins["bin"].max() + 2)
    below = lambda rows: np.array([rows.loc[rows["bin"] < e, "count"].sum() for e in edges])
    good, bad = bins[bins["good"]], bins[~bins["good"]]
    cost = clean_cost * below(good) + (bad["count"].sum() - below(bad))
    cheapest = edges[cost == cost.min()]
    return float((cheapest[0] + cheapest[-1]) / 2)


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value of a column by repeated histograms of fixed size; None if k is below 1."""
    inside = keys.where(F.col(column).isNotNull())
    ends = inside.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or not ends[2]:
        return None
    low, high, rank = ends[0], ends[1], min(k, ends[2])
    while low < high:
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        found = inside.where(F.col(column).between(low, high)).groupBy(place.alias("p")).agg(F.count(column).alias("n"), F.min(column).alias("a"), F.max(column).alias("b"))
        for row in found.orderBy(F.desc("p")).collect():
            if rank <= row["n"]:
                low, high = row["a"], row["b"]
                break
            rank -= row["n"]
    return low


def resample(
    docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = 1.0, seed: int = 17, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", **fitting,
) -> tuple[DataFrame, Model, float | None]:
    """(decisions, model, threshold): decisions are (id, n_ngrams, log_weight, key, kept) of every document."""
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    scored = durable(weigh(docs, model, [id_col], text_col, temperature, id_col, seed).drop("ratio"))
    n, positive = scored.agg(F.count("log_weight"), F.count_if(F.col("log_weight") > 0)).first()
    k = positive if share is None else round(share * n)
    least = kth_largest(scored, "key", k)
    kept = F.lit(False) if least is None else F.coalesce(F.col("key") >= F.lit(least), F.lit(False))
    return scored.withColumn("kept", kept), model, least


def keep(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """The rows of `docs` that are drawn, with their columns.  Texts are scored again rather than shuffled."""
    _, model, least = resample(docs, labels, share, temperature, seed, None, id_col, text_col, **fitting)
    if least is None:
        return docs.limit(0)
    plain, names = unnamed(docs)
    again = weigh(plain, model, plain.columns, names[text_col], temperature, names[id_col], seed)
    return again.where(F.col("key") >= F.lit(least)).select(*plain.columns).toDF(*docs.columns)
