"""Book archives: zip files of manifest, pages, pictures and corrections, read and written by tasks.

Folders of archives are read and written by the data source of `bookzip`; the functions here are about what the members hold.
`archives` packs the members of a book in one task, one archive per row, for tables that hold archives.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bookzip

MOVE = "id string, block string, span array<int>, raw string, san string, uci string, fen string, ok boolean, variation_depth int, rects array<array<int>>"
BLOCK = "id string, bbox array<int>, text string, moves array<string>, style struct<bold: boolean, color: string>"
DIAGRAM = (
    "id string, bbox array<int>, image string, fen string, confidence double, reviewed boolean, flipped boolean, orientation_sure boolean, "
    "issues array<string>, matches_move string, side_known boolean, side_source string"
)


def _array(fields: str) -> str:
    return "array<struct<" + ", ".join(f.replace(" ", ": ", 1) for f in re.split(r", (?![^<]*>)", fields)) + ">>"


PAGE = f"page int, width int, height int, blocks {_array(BLOCK)}, moves {_array(MOVE)}, diagrams {_array(DIAGRAM)}, background string"
MANIFEST = "schema_version int, title string, language string, figurine_notation boolean, page_count int, has_scans boolean, dpi int"
CORRECTION = _array("target string, type string, value string, source_hash string")


def members(spark: SparkSession, folder: str, suffix: str = bookzip.SUFFIX) -> DataFrame:
    """(book, name, bytes) of all members of the archives of a folder and its folders; unreadable archives have none."""
    return bookzip.read(spark, folder, suffix=suffix).select("book", "name", "bytes")


def _json(rows: DataFrame, begin: str, middle: str, end: str, schema: str, root: str | None = None) -> DataFrame:
    text = F.decode("bytes", "UTF-8")
    named = rows.where(F.col("name").startswith(begin) & F.col("name").endswith(end))  # these filters reach the reader
    return named.where(F.col("name").rlike(f"^{begin}{middle}{end}$".replace(".", r"\."))).select("book", F.from_json(F.get_json_object(text, root) if root else text, schema).alias("d"))


def pages(rows: DataFrame) -> DataFrame:
    """(book, page, width, height, blocks, moves, diagrams, background)."""
    return _json(rows, "pages/p", r"\d+", ".json", PAGE).select("book", "d.*")


def manifests(rows: DataFrame) -> DataFrame:
    return _json(rows, "manifest", "", ".json", MANIFEST).select("book", "d.*").withColumn("dpi", F.coalesce("dpi", F.lit(200)))


def corrections(rows: DataFrame) -> DataFrame:
    """(book, target, type, value, source_hash)."""
    return _json(rows, "corrections", "", ".json", CORRECTION, "$.corrections").select("book", F.explode("d").alias("c")).select("book", "c.*")


def page_documents(blocks: DataFrame, moves: DataFrame, sizes: DataFrame, diagrams: DataFrame | None = None) -> DataFrame:
    """(book, name, bytes) of the pages' JSON documents from flat tables (book, page, ord, ...)."""
    listed = lambda df, name: df.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in df.columns if c not in ("book", "page", "ord")]))).alias(name))
    parts = {"blocks": blocks, "moves": moves} | ({} if diagrams is None else {"diagrams": diagrams})
    whole = sizes
    for name, rows in parts.items():
        whole = whole.join(listed(rows, name), ["book", "page"], "left")
    without = lambda c: F.transform(F.coalesce(c, F.array().cast(whole.schema[c].dataType)), lambda x: x.dropFields("ord"))
    text = F.to_json(F.struct("page", "width", "height", *[without(name).alias(name) for name in parts]))
    return whole.select("book", F.format_string("pages/p%04d.json", F.col("page").cast("int")).alias("name"), F.encode(text, "UTF-8").alias("bytes"))


def matched_diagrams(documents: DataFrame) -> DataFrame:
    """(book, id, fen, full): diagrams of pages that match a legal move of their book, with that move's full position."""
    moves = documents.select("book", F.explode("moves").alias("m")).where("m.ok").select("book", F.col("m.id").alias("matches_move"), F.col("m.fen").alias("full"))
    shown = documents.select("book", F.explode("diagrams").alias("d")).where("d.matches_move is not null").select("book", "d.id", "d.fen", "d.matches_move")
    return shown.join(moves, ["book", "matches_move"]).select("book", "id", "fen", "full")


def carried_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """The members `new` of books, with the corrections of `old` archives where a book brings none."""
    kept = old.where(F.col("name") == "corrections.json").join(new.where(F.col("name") == "corrections.json").select("book"), "book", "left_anti")
    return new.unionByName(kept.join(new.select("book").distinct(), "book", "left_semi").select(*new.columns))


def archives(rows: DataFrame) -> DataFrame:
    """(book, content): one archive per book from its members, the same bytes for the same members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in sorted(zip(group["name"], group["bytes"], strict=True)):
                archive.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"book": [group["book"].iloc[0]], "content": [out.getvalue()]})

    return rows.groupBy("book").applyInPandas(run, "book string, content binary")


def checked_files(spark: SparkSession, folder: str, sums: DataFrame) -> DataFrame:
    """(file, ok): whether each file listed in `sums` (file, sha256) is in the folder with that checksum."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    return sums.join(found, "file", "left").select("file", F.coalesce(F.lower("sha256") == F.col("found"), F.lit(False)).alias("ok"))
