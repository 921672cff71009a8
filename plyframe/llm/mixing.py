"""Mixing sources to target weights by a time-varying curriculum.  DataFrame functions only.

Sources in code-point order, null last, get the weights of `weights` in turn and share all words in these proportions;
a target stops at `cap` times its source's words and the excess is shared again by weight until none is above.
Each source has a schedule, a piecewise linear intensity over the training time u in [0, 1].  Its integral G(u), scaled
to the target, is the source's cumulative demand.  The documents of a source are laid one after another in the order of
md5(doc_id), the whole order again for each further copy; a copy that starts after x of the source's T words is assigned
the position where the demand reaches x, that is total * G^-1(x / T).  `curriculum` range-sorts the copies by position.

A source of any size is laid out by two running sums: it is split into about sqrt(rows) ranges of md5, one running sum
goes over the ranges and one inside each range, so no task holds a source; the row of each source is broadcast where these are
few, as a join by source would leave each in one task.

Defined cases: a null text has size 0; a null doc_id sorts first; a document of size 0 is never taken; repeated rows are
documents of their own (in one order among equals); an empty table gives an empty plan; only the copy that crosses the
target is cut, so a source's taken words are its target rounded.  Output names replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, small, unnamed

WEIGHTS = (5, 2, 1)
#: By weight: (time, intensity) knots.  Heavy sources fade, light ones grow, the middle stays.
SCHEDULES = {5: ((0.0, 1.25), (1.0, 0.75)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def inverse(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the share x of the schedule's integral is reached."""
    segments = list(zip(knots, knots[1:], strict=False))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in segments)
    done, out = 0.0, None
    for (t0, m0), (t1, m1) in segments:
        piece = (t1 - t0) * (m0 + m1) / 2
        rest, slope = F.greatest(x * F.lit(area) - F.lit(done), F.lit(0.0)), (m1 - m0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(m0 * m0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.when(rest <= 0, F.lit(t0)).otherwise(F.least(F.lit(t0) + F.lit(2.0) * rest / (F.lit(m0) + root), F.lit(t1)))
        done += piece
        out = F.when(x * F.lit(area) < F.lit(done), at) if out is None else out.when(x * F.lit(area) < F.lit(done), at)
    return out.otherwise(F.lit(1.0))


def targets(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: (source_key, source_size, n_rows, weight, total, target)."""
    per = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_key, everything = Window.orderBy("source_key"), Window.orderBy("ratio", "source_key")
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = per.withColumn("weight", F.get(turn, ((F.row_number().over(by_key) - 1) % len(weights)).cast("int")))
    ranked = ranked.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    after = everything.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn("total", F.sum("source_size").over(whole)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(whole)
    filled = level.withColumn("fill", first["level"])
    target = F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.col("fill") * F.col("weight"))
    return filled.select("source_key", "source_size", "n_rows", "weight", "total", target.alias("target"))


def plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, schedules: Mapping[int, Sequence[tuple[float, float]]] = SCHEDULES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of `docs` with size, source_size, target, taken and `copies`: array of (copy, words, position)."""
    made = ["size", "source_size", "target", "taken", "copies"]
    plain, names = unnamed(docs)
    source = F.col(names[source_col]).cast("string")
    sized = plain.select(
        *plain.columns,
        F.coalesce(F.regexp_count(F.col(names[text_col]), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("source_key"),
        F.coalesce(F.md5(F.col(names[id_col]).cast("string")), F.lit("0" * 32)).alias("order_key"),
    )
    sources = durable(targets(sized.select("source_key", "size"), weights, cap))
    share = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    laid = sized.join(small(sources), "source_key").withColumn("range", F.floor(share * F.ceil(F.sqrt("n_rows"))).cast("long"))
    ranges = laid.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source_key", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "range").orderBy("order_key", names[id_col], "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.join(ranges, ["source_key", "range"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    quota = F.floor(F.col("target") + F.lit(0.5))
    at = lambda k: F.lit(k) * F.col("source_size") + F.col("start")
    words = [F.greatest(F.lit(0), F.least(F.col("size"), quota - at(k))).cast("long") for k in range(cap)]
    time = None
    for weight in dict.fromkeys(weights):
        when = lambda x, w=weight: inverse(x, schedules.get(w, ((0.0, 1.0), (1.0, 1.0))))
        branch = (F.col("weight") == weight, when)
        time = [branch] if time is None else [*time, branch]
    position = lambda k: F.col("total") * F.coalesce(*[F.when(c, f(at(k) / F.col("target"))) for c, f in time])
    copies = F.array(*[F.when(w > 0, F.struct(F.lit(k).alias("copy"), w.alias("words"), position(k).alias("position"))) for k, w in enumerate(words)])
    taken = words[0]
    for w in words[1:]:
        taken = taken + w
    return placed.select(
        *[F.col(names[c]).alias(c) for c in docs.columns if c not in made], "size", "source_size", "target", taken.alias("taken"), F.array_compact(copies).alias("copies")
    )


def curriculum(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per copy that is taken, range-sorted by its training position (columns copy, words, position)."""
    rows = planned.withColumn("c", F.explode("copies")).drop("copies")
    rows = rows.withColumns({"copy": F.col("c.copy"), "words": F.col("c.words"), "position": F.col("c.position")}).drop("c")
    return rows.orderBy("position", id_col, "copy")
