"""Corrections, reports and message catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PAGE_REACH
from ..functions import text as T


def last_wins(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the highest version."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of `old` replaced by those of `new` with the same key, and the other rows of `new`."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return last_wins(both, key, "_v").drop("_v")


def effective(diagrams: DataFrame, corrections: DataFrame) -> DataFrame:
    """(id, value, corrected, needs_review): a correction counts while the generated value is the one it was made for."""
    joined = diagrams.join(corrections.withColumnRenamed("target", "id").withColumnRenamed("value", "new"), "id", "left")
    given = F.coalesce(F.col("type") == "diagram_fen", F.lit(False))
    holds = given & (F.col("source_hash") == T.content_hash(F.coalesce(F.col("fen"), F.lit(""))))
    return joined.select("id", F.when(holds, F.col("new")).otherwise(F.col("fen")).alias("value"), holds.alias("corrected"), (given & ~holds).alias("needs_review"))


def page_report(pages: DataFrame, moves: DataFrame, figures: DataFrame) -> DataFrame:
    """(page, moves, illegal, located, figures, read, matched, line) of every page, with or without moves and figures.

    Moves are (page, ok, rects), figures (page, fen, matches); `located` moves have rectangles on the page.
    """
    m = moves.groupBy("page").agg(F.count_if("ok").alias("moves"), F.count_if(~F.col("ok")).alias("illegal"), F.count_if(F.size("rects") > 0).alias("located"))
    f = figures.groupBy("page").agg(F.count(F.lit(1)).alias("figures"), F.count("fen").alias("read"), F.count("matches").alias("matched"))
    out = pages.select("page").distinct().join(m, "page", "left").join(f, "page", "left").fillna(0, ["moves", "illegal", "located", "figures", "read", "matched"])
    part = lambda c, name: F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(name)))
    line = F.concat_ws(", ", F.concat(F.col("moves").cast("string"), F.lit(" moves")), part("located", "located"), part("illegal", "illegal"), part("figures", "figures"), part("read", "read"), part("matched", "matched"))
    return out.withColumn("line", line)


def titled(books: DataFrame) -> DataFrame:
    """(book, title) of books (book, path, given, title): the title asked for, else that of the file's metadata, else its name."""
    return books.select("book", T.first_filled(F.col("given"), F.col("title"), T.file_stem(F.col("path"))).alias("title"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(agree, total): rows with both values, and those where they are equal."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.agg(F.count_if(both & (F.col(a) == F.col(b))).alias("agree"), F.count_if(both).alias("total"))


def unfinished(pages: DataFrame, done: DataFrame) -> DataFrame:
    """The pages with no output yet."""
    return pages.join(done.select("page").distinct(), "page", "left_anti")


def broken_keys(messages: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(key, missing, placeholders): keys that lack a language, or whose texts differ in their placeholders."""
    marks = F.concat_ws(",", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{(\w+)"), 1))))
    sets = messages.withColumn("marks", marks).groupBy("key").agg(F.collect_set("lang").alias("langs"), F.count_distinct("marks").alias("placeholders"))
    missing = F.array_join(F.array_except(F.array(*[F.lit(x) for x in languages]), F.col("langs")), ",")
    return sets.select("key", missing.alias("missing"), F.col("placeholders").cast("int").alias("placeholders")).where("missing <> '' or placeholders > 1")



def near_pages(pages: DataFrame, others: DataFrame, reach: int = PAGE_REACH) -> DataFrame:
    """(page, q, away, ...): the rows of `others` (q, ...) on pages at most `reach` away from each page; each page meets few keys."""
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    rows = pages.withColumn("_step", steps).withColumn("q", F.col("page") + F.col("_step")).join(others, "q")
    return rows.select("page", "q", F.abs("_step").alias("away"), *[c for c in others.columns if c != "q"])


def stacked(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, absent columns null, with the number of their frame (`source`) to order by."""
    numbered = [f.select(F.lit(i).alias("source"), "*") for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
