"""Text layers of pages: the word boxes of a page's markup as blocks, in pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DPI
from ..functions import geometry as G
from ..functions import text as T
from .bookzip import store

# Fixed value: the labels whose text is read for moves.
READ_LABELS = ("text", "paragraph_title")

#: Characters of files after which what a task has read goes on.
READ_CHARS = 4 << 20

_LINE, _WORD = r"(?s)<line[^>]*>(.*?)</line>", r"(?s)(<word[^>]*>.*?</word>)"


def _number(tag, name: str):
    return F.regexp_extract(tag, rf'{name}="([-0-9.]+)"', 1).cast("double")


def words(pages: DataFrame, dpi: int = DPI) -> DataFrame:
    """(page, ord, word, text, start, end, bbox) of (page, markup): offsets in the line's text, boxes scaled from points."""
    lines = pages.select("page", F.posexplode(F.regexp_extract_all("markup", F.lit(_LINE), 1)).alias("ord", "inner"))
    found = lines.select("page", "ord", F.posexplode(F.regexp_extract_all("inner", F.lit(_WORD), 1)).alias("word", "tag"))
    box = G.box(*[_number(F.col("tag"), k) for k in ("xMin", "yMin", "xMax", "yMax")])
    found = found.withColumns({"text": T.plain_html(F.col("tag")), "bbox": G.scaled(box, dpi / 72)})
    before = Window.partitionBy("page", "ord").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return found.withColumn("start", start).select("page", "ord", "word", "text", "start", (F.col("start") + F.length("text")).alias("end"), "bbox")


def blocks(pages: DataFrame, dpi: int = DPI) -> DataFrame:
    """One text block per printed line: (page, ord, label, text, bbox)."""
    parts = F.array_sort(F.collect_list(F.struct("word", "text")))
    edges = [f(f"bbox.{k}") for f, k in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    rows = words(pages, dpi).groupBy("page", "ord").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), G.box(*edges).alias("bbox"))
    return rows.select("page", "ord", F.lit("text").alias("label"), "text", "bbox")


_LIST = "array<struct<block_label: string, block_content: string, block_bbox: array<int>>>"


def _contents(pages: DataFrame, folder: str) -> DataFrame:
    """(page, value): the files of pages (page) by their names, read in tasks; pages without a file have no row."""

    def run(frames):
        where, base = store(folder)
        for frame in frames:
            found, held = [], 0
            for page in frame["page"]:
                try:
                    with where.open_input_stream(f"{base}/p{page}.json") as file:
                        found.append((page, file.read().decode()))
                except FileNotFoundError:
                    continue
                held += len(found[-1][1])
                if held >= READ_CHARS:
                    yield pd.DataFrame(found, columns=["page", "value"])
                    found, held = [], 0
            yield pd.DataFrame(found, columns=["page", "value"])

    return pages.where(F.col("page").isNotNull()).select(F.col("page").cast("long")).mapInPandas(run, "page long, value string")


def block_lists(spark: SparkSession, folder: str, labels: tuple[str, ...] | None = READ_LABELS, pages: DataFrame | None = None) -> DataFrame:
    """(page, ord, label, text, bbox) of JSON files that hold the list of a page's blocks each, with the page's number in their name.

    `ord` is a block's place in its list, also where other labels are left out.  Where `pages` (page) are given, their files p<page>.json are
    read by name, and the driver lists no files.
    """
    page = F.regexp_extract(F.input_file_name(), r"p(\d+)[^/]*\.json$", 1).cast("long").alias("page")
    texts = spark.read.text(folder, wholetext=True).select(page, "value") if pages is None else _contents(pages, folder)
    files = texts.select("page", F.from_json("value", _LIST).alias("l"))
    rows = files.select("page", F.posexplode("l").alias("ord", "b"))
    kept = rows if labels is None else rows.where(F.col("b.block_label").isin(*labels))
    corner = lambda i: F.get("b.block_bbox", F.lit(i))
    return kept.select("page", "ord", F.col("b.block_label").alias("label"), F.col("b.block_content").alias("text"), G.box(*[corner(i) for i in range(4)]).alias("bbox"))
