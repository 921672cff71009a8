"""From blocks to a report: the block stages in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import NUMBERED
from ..operators import blocks as K
from .sources import BLOCKS_SQL, blocks


def book_report(spark, d):
    """(page, blocks, chars, last, cut) of each page: its text blocks, their length, where the last one ends, and how many
    of them run on into a later one."""
    text = K.book_text(K.footers_to_text(blocks(spark, d)))
    placed = K.with_offsets(text).join(K.tails_repeated(text), ["page", "ord"], "left")
    return placed.groupBy("page").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("b").alias("last"), F.count("cut").alias("cut"))


QUERIES = {
    "book_report": (book_report, f"""WITH {BLOCKS_SQL}, f AS (SELECT page, ord, CASE WHEN label = 'footer' AND regexp_matches(text, '{NUMBERED}') THEN 'text' ELSE label END AS label, text FROM blocks),
        t AS (SELECT page, ord, text, regexp_replace(text, '\\s+', '', 'g') AS flat FROM f WHERE label IN ('text', 'paragraph_title', 'header', 'doc_title') AND regexp_matches(text, '\\S')),
        c AS (SELECT DISTINCT a.page, a.ord FROM t a JOIN t b ON a.page = b.page AND b.ord > a.ord AND length(b.flat) >= 25 AND instr(substr(a.flat, 2), substr(b.flat, 1, 25)) > 0)
        SELECT t.page, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS last, count(c.ord) AS cut FROM t LEFT JOIN c ON t.page = c.page AND t.ord = c.ord GROUP BY t.page"""),
}
