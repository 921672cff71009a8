"""Results that are kept by their content: what was computed once by some version of the code is read the next time.

The store is a folder of Parquet files by version and by the first digits of the key, so a lookup reads the parts its keys can be in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Hexadecimal digits of a key that name its part of the store.
DIGITS = 2


def through(inputs: DataFrame, content: Column, folder: str, version: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`inputs` with the columns that `compute` gives for their content, taken from the store where it has them.

    `compute` gets the columns of `inputs` and `key`, one row for each content that the store lacks for this version, and returns `key` and its
    results.  These are appended in one job, whose files appear when it has ended; a second call computes nothing, another version
    everything.  Two calls at once may both append a key: readers take one of its rows.  Rows without content have no results.
    """
    spark = inputs.sparkSession
    keyed = inputs.withColumn("key", T.cache_key(content, version))
    place = f"{folder}/version={version}"
    prefix = F.substring("key", len(version) + 2, DIGITS)

    def stored() -> DataFrame | None:
        try:
            return spark.read.option("basePath", folder).parquet(place).drop("version").dropDuplicates(["prefix", "key"])
        except AnalysisException as none:
            if none.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    wanted, known = keyed.where(F.col("key").isNotNull()).dropDuplicates(["key"]), stored()
    missing = wanted if known is None else wanted.withColumn("prefix", prefix).join(known.select("prefix", "key"), ["prefix", "key"], "left_anti").drop("prefix")
    compute(missing).withColumn("prefix", prefix).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(place)
    known = stored()
    if known is None:  # nothing has ever been computed
        known = compute(wanted.limit(0)).withColumn("prefix", prefix)
    return keyed.withColumn("prefix", prefix).join(known, ["prefix", "key"], "left").drop("prefix", "key")
