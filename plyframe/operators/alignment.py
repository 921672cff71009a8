"""From spans of a block's text to rectangles on its page, through a second reading that knows where its characters are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALIGNED_SHARE, ROW_BUCKET
from ..functions import geometry as G
from ..functions.align import align
from .spatial import lines_in_boxes, merged_rows

_BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def printed_lines(pieces: DataFrame) -> DataFrame:
    """(page, line, text, chars, bbox, cx, cy) of lines given as pieces (page, line, seq, text, bbox); lines without characters go.

    `chars` are the boxes of the characters: that of a piece shared out evenly.
    """
    one = F.struct("seq", "text", F.col("bbox").alias("b"))
    lines = pieces.where("text <> ''").groupBy("page", "line").agg(F.array_sort(F.collect_list(one)).alias("p"))
    chars = F.flatten(F.transform("p", lambda p: G.character_boxes(p["text"], p["b"]))).cast(_BOXES)
    edge = lambda end, c: end(F.transform("p", lambda p: p["b"][c]))
    bbox = G.box(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
    rows = lines.select("page", "line", F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"), chars.alias("chars"), bbox.alias("bbox"))
    x, y = G.centre(F.col("bbox"))
    return rows.withColumns({"cx": x, "cy": y})


def block_streams(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, ord, stream, chars): the text of the lines whose centre a block (page, ord, bbox) holds, row by row, with its boxes.

    Each line is followed by a blank that has no box.
    """
    held = lines_in_boxes(lines.withColumnRenamed("bbox", "line_box"), blocks.select("page", "ord", "bbox"))
    one = F.struct(F.bround(F.col("cy") / ROW_BUCKET).alias("row"), F.col("line_box.x0").alias("x"), "line", F.concat("text", F.lit(" ")).alias("t"), F.concat("chars", F.array(F.lit(None).cast(_BOXES[6:-1]))).alias("c"))
    whole = held.groupBy("page", "ord").agg(F.array_sort(F.collect_list(one)).alias("l"))
    return whole.select("page", "ord", F.array_join(F.transform("l", lambda x: x["t"]), "").alias("stream"), F.flatten(F.transform("l", lambda x: x["c"])).alias("chars"))


def _partners(a: Column, b: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align(x, y).astype("int32") for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])

    return run(a, b)


def aligned_share(pairs: DataFrame) -> DataFrame:
    """`share` of the characters of `a` that align with `b`, and whether that is enough to place them."""
    n = F.size(F.filter(_partners(F.regexp_replace("a", "\n", " "), F.col("b")), lambda i: i >= 0))
    out = pairs.withColumn("share", F.when(F.length("a") > 0, n / F.length("a")).otherwise(0.0))
    return out.withColumn("placed", F.col("share") >= ALIGNED_SHARE)


def span_rects(blocks: DataFrame, streams: DataFrame) -> DataFrame:
    """(page, ord, span, s, e, share, rects): where each span of a block (page, ord, text, spans) is printed.

    `share` is the part of a span's characters that align with characters that have a box; with less than 60 % or none `rects` is null,
    otherwise it has one rectangle [x, y, w, h] for each row.  Blocks without a stream have spans of share 0.
    """
    joined = blocks.join(streams, ["page", "ord"], "left").withColumn("to", _partners(F.regexp_replace("text", "\n", " "), F.coalesce("stream", F.lit(""))))
    def placed(x: Column) -> Column:
        partners = F.filter(F.slice("to", x["s"] + 1, F.greatest(x["e"] - x["s"], F.lit(0))), lambda i: i >= 0)
        boxes = F.filter(F.transform(partners, lambda i: F.get("chars", i)), lambda b: b.isNotNull())
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.coalesce(boxes, F.array().cast(_BOXES)).alias("hit"))

    # the boxes of each span are picked before spans become rows, so that no row repeats those of the whole block
    hits = joined.select("page", "ord", F.transform("spans", placed).alias("spans")).select("page", "ord", F.posexplode("spans").alias("span", "x")).select("page", "ord", "span", "x.*")
    size = F.col("e") - F.col("s")
    enough = (F.size("hit") >= ALIGNED_SHARE * size) & (F.size("hit") > 0)
    share = F.when(size > 0, F.size("hit") / size).otherwise(0.0)
    return hits.select("page", "ord", "span", "s", "e", share.alias("share"), F.when(enough, merged_rows(F.col("hit"))).alias("rects"))
