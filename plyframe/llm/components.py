"""Connected components of an edge table, without collecting it: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _hook(pairs: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) point to its smallest neighbour or itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node with an edge to another one; root is the component's smallest node."""
    now = durable(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        print_ = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if print_ == seen or not print_[0]:
            break
        seen = print_
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = _hook(both, larger=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = durable(_hook(star, larger=False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
