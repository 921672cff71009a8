"""Progress lines `@@PROGRESS<tab>label<tab>i<tab>n<tab>note`, as a batch table or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def parsed(lines: DataFrame) -> DataFrame:
    """(label, i, n, note) of the lines of the protocol; other lines are left out."""
    part = F.split("value", "\t", 5)
    rows = lines.where(F.col("value").startswith("@@PROGRESS\t") & (F.size(part) >= 4))
    return rows.select(part[1].alias("label"), F.expr("try_cast(split(value, '\t', 5)[2] AS int)").alias("i"), F.expr("try_cast(split(value, '\t', 5)[3] AS int)").alias("n"), F.coalesce(F.get(part, F.lit(4)), F.lit("")).alias("note"))


def latest(progress: DataFrame) -> DataFrame:
    """(label, i, n, note, share): the farthest state of each step.  Works on a stream in update or complete mode."""
    best = progress.groupBy("label").agg(F.max(F.struct("i", "n", "note")).alias("s")).select("label", "s.*")
    return best.withColumn("share", F.col("i") / F.greatest(F.col("n"), F.lit(1)))


def overall(messages: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """(run, stage, steps, clock, state, code) of each run from its messages (run, at, label, code), `at` in seconds.

    stage: the number, from 1, of the step that was named last, null before the first and for labels that are no step.  A
    message with a code ends its run: done with 0, otherwise stopped; the last one counts.  clock: from the first message to
    the last.  Partial sums come before the shuffle; works on a stream as `latest` does.
    """
    number = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("label")).cast("int")
    last = lambda value, given: F.max(F.when(given, F.struct("at", value.alias("value"))))["value"]
    out = messages.groupBy("run").agg(last(number, number > 0).alias("stage"), (F.max("at") - F.min("at")).alias("seconds"), last(F.col("code"), F.col("code").isNotNull()).alias("code"))
    state = F.when(F.col("code").isNull(), "running").when(F.col("code") == 0, "done").otherwise("stopped")
    return out.select("run", "stage", F.lit(len(steps)).alias("steps"), T.mmss(F.col("seconds")).alias("clock"), state.alias("state"), "code")


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the latest states from the text files of a folder."""
    return latest(parsed(spark.readStream.text(folder)))


def process_new_pages(pages: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each page of a stream is processed once and appended to `out`; a later call goes on where this one ended."""
    return process(pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
