"""Matching of board readings to the positions of games.  A board is 64 characters (see functions.boards)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_WRONG_SQUARES, SNAP_LIMIT, SNAP_MARGIN
from ..functions import boards as B


def known_positions(moves: DataFrame, starts: DataFrame) -> DataFrame:
    """The distinct placements of legal moves and of starts."""
    return moves.where("ok").select("placement").unionByName(starts.select("placement")).where(F.col("placement").isNotNull()).distinct()


def known_readings(readings: DataFrame, known: DataFrame) -> DataFrame:
    """The readings whose placement is known."""
    return readings.join(known.select("placement"), "placement", "left_semi")


def first_known(readings: DataFrame, known: DataFrame) -> DataFrame:
    """(diagram, placement, place): the first known reading of each diagram by place."""
    return known_readings(readings, known).groupBy("diagram").agg(F.min(F.struct("place", "placement")).alias("r")).select("diagram", "r.placement", "r.place")


def matched_moves(diagrams: DataFrame, moves: DataFrame, starts: DataFrame) -> DataFrame:
    """(diagram, page, matches): the move with a diagram's placement, own page first, then by page and move; or `start`."""
    hit = moves.where("ok").select("placement", F.col("page").alias("m_page"), "move", "id")
    # one pass over the moves for each placement first, so that a frequent placement does not meet each of its moves
    first = hit.groupBy("placement").agg(F.min(F.struct("m_page", "move", "id")).alias("any"))
    own = diagrams.join(hit.withColumnRenamed("m_page", "page"), ["placement", "page"], "left").groupBy("diagram").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("move", "id"))).alias("own"))
    joined = diagrams.join(own, "diagram", "left").join(first, "placement", "left").join(starts.select("page", F.col("placement").alias("start")), "page", "left")
    found = F.coalesce(F.col("own.id"), F.col("any.id"), F.when(F.col("start") == F.col("placement"), F.lit("start")))
    return joined.select("diagram", "page", found.alias("matches"))


def snapped(readings: DataFrame, known: DataFrame, limit: int = SNAP_LIMIT, margin: int = SNAP_MARGIN) -> DataFrame:
    """(reading, cells, off): the nearest known board within `limit` squares if the next one is `margin` squares farther.

    Boards that differ on fewer than `limit + margin` squares agree on one of as many segments, so candidates come from
    equality joins on segments, not from all pairs.
    """
    parts = limit + margin
    width = -(-64 // parts)
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("i"), F.substring(F.col("cells"), i * width + 1, F.lit(width)).alias("piece")))).alias("seg")
    left = readings.select("reading", "cells", cut).select("reading", "cells", "seg.*")
    right = known.select("cells").distinct().select("cells", cut).select(F.col("cells").alias("other"), "seg.*")
    pairs = left.join(right, ["i", "piece"]).select("reading", "cells", "other").distinct()
    near = pairs.withColumn("off", B.distance(F.col("cells"), F.col("other"))).where(F.col("off") < parts)
    order = Window.partitionBy("reading").orderBy("off", "other")
    ranked = near.withColumns({"rank": F.row_number().over(order), "next": F.lead("off").over(order)})
    best = ranked.where((F.col("rank") == 1) & (F.col("off") <= limit) & (F.col("next").isNull() | (F.col("next") >= F.col("off") + margin)))
    return best.select("reading", F.col("other").alias("cells"), "off")


def nearest_exemplar(glyphs: DataFrame, exemplars: DataFrame, cut: float, per_group: int = 1024) -> DataFrame:
    """(id, letter, distance): the nearest exemplar (letter, v) of each glyph (id, v); letter null beyond `cut`.

    Distances are compared as they are and shown to six places; of equal ones the smallest letter is taken.
    Exemplars are usually a handful of pictures per letter: up to `per_group` are gathered into one row, counted and broadcast.
    More are gathered into groups of about that size, and each glyph meets every group by an equality join.
    """
    groups = max(1, -(-exemplars.count() // per_group))
    row = exemplars.groupBy(F.pmod(F.xxhash64("letter", "v"), F.lit(groups)).alias("group")).agg(F.array_sort(F.collect_list(F.struct("letter", "v"))).alias("all"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    each = glyphs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    joined = each.join(F.broadcast(row) if groups == 1 else row, "group")
    best = F.array_min(F.transform("all", lambda e: F.struct(gap(F.col("v"), e["v"]).alias("d"), e["letter"].alias("letter"))))
    found = joined.select("id", best.alias("best"))
    found = found if groups == 1 else found.groupBy("id").agg(F.min("best").alias("best"))
    return found.select("id", F.when(F.col("best.d") <= cut, F.col("best.letter")).alias("letter"), F.bround("best.d", 6).alias("distance"))


def full_positions(diagrams: DataFrame, moves: DataFrame) -> DataFrame:
    """`full`: the whole position (fen) of the move (book, id) that a diagram (book, matches) was found to show; null without one."""
    return diagrams.join(moves.select("book", F.col("id").alias("matches"), F.col("fen").alias("full")), ["book", "matches"], "left")


def training_rows(readings: DataFrame, held_books: Sequence[int], most: int = MAX_WRONG_SQUARES) -> DataFrame:
    """Readings (book, read, truth) with at most `most` squares wrong, and whether their book is `held` for evaluation."""
    return readings.where(B.distance(F.col("read"), F.col("truth")) <= most).withColumn("held", F.col("book").isin(*held_books))


def first_best(candidates: DataFrame, key: str, score: str, place: str) -> DataFrame:
    """(key, score, place): the best candidate of each key, the first one among equals."""
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(place)).alias("back")))
    return candidates.groupBy(key).agg(best.alias("b")).select(key, F.col("b.score").alias(score), (-F.col("b.back")).alias(place))


def error_report(readings: DataFrame) -> DataFrame:
    """(book, boards, ghost, missing, wrong) of (book, read, truth) per book, and in all where book is null."""
    e = readings.withColumn("e", B.errors(F.col("read"), F.col("truth")))
    return e.rollup("book").agg(F.count(F.lit(1)).alias("boards"), *[F.sum(f"e.{k}").cast("long").alias(k) for k in ("ghost", "missing", "wrong")])


def unique_best(candidates: DataFrame, key: str, score: str) -> DataFrame:
    """The best candidate of each key, only where no other one has the same score."""
    w = Window.partitionBy(key)
    top = candidates.withColumn("best", F.max(score).over(w)).where(F.col(score) == F.col("best"))
    return top.withColumn("ties", F.count(F.lit(1)).over(w)).where("ties = 1").drop("best", "ties")


def shifted_boxes(boxes: DataFrame, cells: int = 8) -> DataFrame:
    """The nine shifts of a square box (id, x, y, side) by a cell at most, the middle one first."""
    step = F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1)))
    out = boxes.withColumn("i", step).withColumn("j", step).withColumn("cell", F.bround(F.col("side") / cells).cast("int"))
    return out.select("id", "i", "j", (F.col("x") + F.col("i") * F.col("cell")).alias("x"), (F.col("y") + F.col("j") * F.col("cell")).alias("y"), "side")


def held_out_report(readings: DataFrame, held: Column, usable: int = 3) -> DataFrame:
    """(boards, off, off_held, usable) of readings (cells, read): wrong squares of all and of held-out books, and boards with few of them."""
    rows = readings.withColumn("off", B.distance(F.col("read"), F.col("cells")))
    return rows.agg(F.count(F.lit(1)).alias("boards"), F.sum("off").cast("long").alias("off"), F.sum(F.when(held, F.col("off"))).cast("long").alias("off_held"), F.count_if(F.col("off") <= usable).alias("usable"))
