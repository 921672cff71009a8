"""Order-sensitive statistics: trends, gaps, sessions and votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TREND_LEAST, TREND_POINTS


def trend(rows: DataFrame, key: str | list[str], position: Column, value: Column) -> DataFrame:
    """(key, points, trend), the key one column or several: 1 if values grow with the position, -1 if they shrink, null without a clear trend."""
    p, v = position.cast("double"), value.cast("double")
    r = F.try_divide(F.covar_pop(p, v), F.stddev_pop(p) * F.stddev_pop(v))
    keys = [key] if isinstance(key, str) else key
    out = rows.groupBy(*keys).agg(F.count(F.when(p.isNotNull() & v.isNotNull(), 1)).alias("points"), r.alias("r"))
    clear = (F.col("points") >= TREND_POINTS) & (F.abs("r") >= TREND_LEAST)
    return out.select(*keys, "points", F.when(clear, F.signum("r").cast("int")).alias("trend"))


def agreed(votes: DataFrame, key: str | list[str], vote: str) -> DataFrame:
    """(key, vote): the vote of each key, null unless all that are given agree."""
    keys = [key] if isinstance(key, str) else key
    out = votes.groupBy(*keys).agg(F.min(vote).alias("low"), F.max(vote).alias("high"))
    return out.select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).alias(vote))


def largest_gap(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, gap, middle): the widest gap between neighbouring values, the later one among equals, and its middle."""
    after = F.lead(value).over(Window.partitionBy(key).orderBy(value))
    pairs = rows.where(F.col(value).isNotNull()).withColumn("after", after).where(F.col("after").isNotNull())
    best = F.max(F.struct((F.col("after") - F.col(value)).alias("gap"), F.col(value).alias("low"), F.col("after").alias("high")))
    return pairs.groupBy(key).agg(best.alias("b")).select(key, "b.gap", ((F.col("b.low") + F.col("b.high")) / 2).alias("middle"))


def gap_groups(rows: DataFrame, key: str, order: Column, gap: float, tie: str) -> DataFrame:
    """`island`: counts up where the distance to the row before exceeds `gap`."""
    w = Window.partitionBy(key).orderBy(order, tie)
    new = F.coalesce(order - F.lag(order).over(w) > gap, F.lit(True))
    return rows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("new")


def median(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, n, median): the middle value, or the mean of the two middle ones."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"))


def page_bounds(rows: DataFrame, key: str) -> DataFrame:
    """(key, first, last) page of each book."""
    return rows.groupBy(key).agg(F.min("page").alias("first"), F.max("page").alias("last"))


def least_of_page(rows: DataFrame, value: str) -> DataFrame:
    """`least`: the smallest value on a row's page, such as the font that fits all of its paragraphs."""
    return rows.withColumn("least", F.min(value).over(Window.partitionBy("page")))


def grouped(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, values): the sorted values of each group, one row as large as the group."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("values"))


def upper_median(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, n, median): the value at place n // 2 of the sorted ones, by two ranks rather than a list."""
    w = Window.partitionBy(key)
    ranked = rows.select(key, value.alias("v")).where(F.col("v").isNotNull())
    ranked = ranked.withColumns({"n": F.count(F.lit(1)).over(w), "at": F.row_number().over(w.orderBy("v")) - 1})
    return ranked.where(F.col("at") == F.floor(F.col("n") / 2)).select(key, "n", F.col("v").alias("median"))
