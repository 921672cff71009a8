"""Queries over blocks, spans and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import NUMBERED
from ..functions import text as T
from ..operators import blocks as K
from ..operators import series
from ..operators import spatial as S
from .sources import BLOCKS_SQL, DEALT_SQL, PLACES_SQL, blocks, boxes, points, table


def page_range_select(spark, d):
    p = F.col("page_id") % 7
    specs = table(spark, d, "pages").select(F.concat_ws("", p + 1, F.lit("-"), p + 3, F.lit(","), F.col("page_id") % 5, F.lit(","), F.col("page_id") + 100).alias("spec")).distinct()
    return K.page_numbers(specs, 8)


PAGE_RANGE = """WITH s AS (SELECT DISTINCT page_id % 7 AS p, page_id % 5 AS q, page_id + 100 AS r FROM pages),
l AS (SELECT (p + 1) || '-' || (p + 3) || ',' || q || ',' || r AS spec, list_filter([p + 1, p + 2, p + 3, q, r], lambda x: x BETWEEN 1 AND 8) AS ps FROM s)
SELECT spec, CAST(i AS INTEGER) AS place, CAST(ps[i] AS INTEGER) AS page FROM (SELECT spec, ps, unnest(range(1, len(ps) + 1)) AS i FROM l)"""


def text_block_filter(spark, d):
    return K.book_text(K.footers_to_text(blocks(spark, d))).select("page", "ord", "label")


def page_text_join(spark, d):
    return K.joined_text(K.book_text(blocks(spark, d))).select("page", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def hybrid_source_route(spark, d):
    return K.route_source(table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")).select("page", T.n_words(F.col("text")).alias("words"), F.col("source"))


def text_layer_extract(spark, d):
    return K.layer_lines(table(spark, d, "pages").select(F.col("page_id").alias("page"), "html"))


def block_offsets(spark, d):
    return K.with_offsets(K.book_text(blocks(spark, d))).select("page", "ord", "a", "b")


def block_ids(spark, d):
    return K.with_ids(K.book_text(blocks(spark, d))).select("page", "ord", "id")


def span_block_join(spark, d):
    placed = K.with_offsets(blocks(spark, d))
    s = F.explode(F.sequence(F.lit(0), F.length("text").cast("long"), F.lit(37)))
    spans = table(spark, d, "documents").select(F.col("doc_id").alias("page"), s.alias("s")).withColumn("e", F.col("s") + 5)
    return S.spans_in_blocks(spans, placed)


def near_dup_tail(spark, d):
    """Every second line runs on into the next one, as readers sometimes do."""
    after = F.lead("text").over(Window.partitionBy("page").orderBy("ord"))
    run_on = F.when(F.col("ord") % 2 == 0, F.concat_ws(" ", F.col("text"), after)).otherwise(F.col("text"))
    return K.tails_repeated(blocks(spark, d).withColumn("text", run_on))


def sparse_blocks(spark, d):
    return K.sparse(blocks(spark, d)).select("page", "ord", F.round("median", 9).alias("median"), "sparse")


def fill_sparse(spark, d):
    again = blocks(spark, d).select("page", "ord", F.concat(F.repeat(F.concat(F.col("text"), F.lit(" ")), (F.col("ord") % 4).cast("int"))).alias("again"))
    filled = K.refill(K.sparse(blocks(spark, d)), again)
    return filled.select("page", "ord", "refilled", F.md5("text").alias("text_md5"))


def line_in_box_join(spark, d):
    return S.lines_in_boxes(points(spark, d, dealt=True), boxes(spark, d, dealt=True)).select("page", "line", "box")


def box_reading_order(spark, d):
    """The lines that boxes hold, as text in reading order."""
    lines = points(spark, d).withColumn("text", F.col("line").cast("string"))
    return S.reading_order(S.lines_in_boxes(lines, boxes(spark, d))).select("page", "box", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def orphan_lines(spark, d):
    return S.lines_outside(points(spark, d, dealt=True), boxes(spark, d, dealt=True)).select("page", "line")


def next_block_below(spark, d):
    """Every box as a line, over the same boxes as blocks of text; pictures and blank blocks lie at the place of some and come before them."""
    lines = boxes(spark, d, dealt=True).withColumnRenamed("box", "line")
    kinds = F.array(F.struct(F.lit("text"), F.lit("x")), F.when(F.col("line") % 7 == 0, F.struct(F.lit("image"), F.lit("x"))), F.when(F.col("line") % 5 == 0, F.struct(F.lit("text"), F.lit(" \n"))))
    each = lines.select("page", "line", "bbox", F.posexplode(F.array_compact(kinds)).alias("at", "kind"))
    below = each.select("page", F.when(F.col("at") == 0, F.col("line")).otherwise(-F.col("line") - 1).alias("ord"), F.col("kind.col1").alias("label"), F.col("kind.col2").alias("text"), "bbox")
    return S.next_below(lines, below)


def layout_obstacles(spark, d):
    return S.allowed_heights(boxes(spark, d, dealt=True))


def style_mode(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("style"), "l_linenumber")
    return S.mode_first(rows, "l_orderkey", "style", "l_linenumber")


def word_span_overlap(spark, d):
    word = lambda i: F.struct((i * 6).alias("start"), (i * 6 + 5).alias("end"), (i * 60).cast("double").alias("x0"), F.lit(10.0).alias("y0"), (i * 60 + 50).cast("double").alias("x1"), F.lit(30.0).alias("y1"))
    words = F.transform(F.sequence(F.lit(0), F.lit(5)), word)
    start = (F.col("o_orderkey") % 20).cast("int")
    rows = table(spark, d, "orders").select("o_orderkey", S.clipped_words(words, start, start + 9).alias("hit"))
    return rows.select("o_orderkey", F.size("hit").alias("n"), F.round(F.array_min(F.transform("hit", lambda b: b["x0"])), 6).alias("x0"), F.round(F.array_max(F.transform("hit", lambda b: b["x1"])), 6).alias("x1"))


def merge_rects(spark, d):
    """Rectangles of the rows of text of each page, from its words in order; a test holds them against a plain loop."""
    word = F.struct("line", F.col("cx").alias("x0"), F.col("cy").alias("y0"), (F.col("cx") + 40).alias("x1"), (F.col("cy") + 20).alias("y1"))
    ordered = points(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(word)).alias("w"))
    only = F.transform("w", lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1")))
    rects = F.transform(S.merged_rows(only), lambda r: F.array_join(r.cast("array<string>"), " "))
    return ordered.select("page", F.size(rects).alias("rows"), F.array_join(rects, "|").alias("rects"))


def crop_grid(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).cast("int").alias("x"), (F.col("p_size") * 2).cast("int").alias("y"), (160 + F.col("p_size") * 4).cast("int").alias("side"), F.lit(420).alias("width"), F.lit(440).alias("height"))
    return S.crop_grid(rows)


def gap_sessions(spark, d):
    rows = table(spark, d, "events").withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    grouped = series.gap_groups(rows, "user_id", F.col("sec"), 1800, "event_id")
    return grouped.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def coordinate_trend(spark, d):
    return series.trend(table(spark, d, "events"), "user_id", F.col("event_id"), F.col("value"))


def vote_merge(spark, d):
    votes = table(spark, d, "events").select("user_id", F.when(F.col("value") > 1, F.col("event_type")).alias("vote"))
    return series.agreed(votes, "user_id", "vote")


def gap_split(spark, d):
    return series.largest_gap(table(spark, d, "events"), "user_id", "value").select("user_id", F.round("gap", 9).alias("gap"), F.round("middle", 9).alias("middle"))


def upper_median(spark, d):
    return series.upper_median(table(spark, d, "documents"), "source", F.col("n_chars"))


QUERIES = {
    "page_range_select": (page_range_select, PAGE_RANGE),
    "text_block_filter": (text_block_filter, f"""WITH {BLOCKS_SQL}, f AS (SELECT page, ord, CASE WHEN label = 'footer' AND regexp_matches(text, '{NUMBERED}') THEN 'text' ELSE label END AS label, text FROM blocks)
        SELECT page, ord, label FROM f WHERE label IN ('text', 'paragraph_title', 'header', 'doc_title') AND regexp_matches(text, '\\S')"""),
    "page_text_join": (page_text_join, f"""WITH {BLOCKS_SQL}, j AS (SELECT page, string_agg(text, ' ' ORDER BY ord) AS t FROM blocks WHERE label IN ('text', 'paragraph_title', 'header', 'doc_title') AND regexp_matches(text, '\\S') GROUP BY page)
        SELECT page, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n FROM j"""),
    "hybrid_source_route": (hybrid_source_route, """WITH w AS (SELECT doc_id AS page, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END AS words FROM documents)
        SELECT page, CAST(words AS INTEGER) AS words, CASE WHEN words >= 60 THEN 'text_layer' ELSE 'ocr' END AS source FROM w"""),
    "text_layer_extract": (text_layer_extract, """WITH p AS (SELECT page_id AS page, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS l FROM pages), q AS (SELECT page, l, unnest(range(len(l))) AS i FROM p)
        SELECT page, CAST(i AS INTEGER) AS ord, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(l[i + 1], '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM q"""),
    "block_offsets": (block_offsets, f"""WITH {BLOCKS_SQL}, t AS (SELECT * FROM blocks WHERE label IN ('text', 'paragraph_title', 'header', 'doc_title') AND regexp_matches(text, '\\S')),
        o AS (SELECT page, ord, CAST(sum(length(text) + 1) OVER (PARTITION BY page ORDER BY ord) - length(text) - 1 AS BIGINT) AS a, length(text) AS n FROM t) SELECT page, ord, a, a + n AS b FROM o"""),
    "block_ids": (block_ids, f"""WITH {BLOCKS_SQL} SELECT page, ord, 'p' || page || '_t' || row_number() OVER (PARTITION BY page ORDER BY ord) AS id FROM blocks WHERE label IN ('text', 'paragraph_title', 'header', 'doc_title') AND regexp_matches(text, '\\S')"""),
    "span_block_join": (span_block_join, f"""WITH {BLOCKS_SQL}, o AS (SELECT page, ord, CAST(sum(length(text) + 1) OVER (PARTITION BY page ORDER BY ord) - length(text) - 1 AS BIGINT) AS a, length(text) AS n FROM blocks),
        s AS (SELECT doc_id AS page, unnest(range(0, length(text) + 1, 37)) AS s FROM documents)
        SELECT s.page, ord, s, s + 5 AS e, s - a AS begin, s + 5 - a AS "end" FROM s JOIN o ON s.page = o.page AND a <= s AND s + 5 <= a + n"""),
    "near_dup_tail": (near_dup_tail, f"""WITH {BLOCKS_SQL}, r AS (SELECT page, ord, CASE WHEN ord % 2 = 0 THEN concat_ws(' ', text, lead(text) OVER (PARTITION BY page ORDER BY ord)) ELSE text END AS text FROM blocks),
        f AS (SELECT page, ord, regexp_replace(text, '\\s+', '', 'g') AS flat FROM r), g AS (SELECT * FROM f WHERE length(flat) >= 25)
        SELECT a.page, a.ord, CAST(min(instr(substr(a.flat, 2), substr(b.flat, 1, 25))) AS INTEGER) AS cut FROM g a JOIN g b ON a.page = b.page AND b.ord > a.ord AND instr(substr(a.flat, 2), substr(b.flat, 1, 25)) > 0 GROUP BY ALL"""),
    "sparse_blocks": (sparse_blocks, f"""WITH {BLOCKS_SQL}, t AS (SELECT page, ord, length(regexp_replace(text, '\\s+', '', 'g')) AS c, (x1 - x0) * (y1 - y0) AS area FROM blocks WHERE label = 'text'),
        m AS (SELECT page, CASE WHEN count(*) >= 3 THEN list_sort(list(c / area))[1 + count(*) // 2] END AS median FROM t GROUP BY page)
        SELECT t.page, ord, round(median, 9) AS median, coalesce(area >= 100000 AND c / area < 0.3 * median, false) AS sparse FROM t JOIN m ON t.page = m.page"""),
    "fill_sparse": (fill_sparse, f"""WITH {BLOCKS_SQL}, t AS (SELECT page, ord, text, repeat(text || ' ', ord % 4) AS again, length(regexp_replace(text, '\\s+', '', 'g')) AS c, (x1 - x0) * (y1 - y0) AS area FROM blocks WHERE label = 'text'),
        m AS (SELECT page, CASE WHEN count(*) >= 3 THEN list_sort(list(c / area))[1 + count(*) // 2] END AS median FROM t GROUP BY page),
        r AS (SELECT t.page, ord, text, again, coalesce(area >= 100000 AND c / area < 0.3 * median, false) AND length(regexp_replace(again, '\\s+', '', 'g')) >= 2.0 * c AS refilled FROM t JOIN m ON t.page = m.page)
        SELECT page, ord, refilled, md5(CASE WHEN refilled THEN trim(again) ELSE text END) AS text_md5 FROM r"""),
    "line_in_box_join": (line_in_box_join, f"WITH {DEALT_SQL} SELECT p.page, line, box FROM points p JOIN boxes b ON p.page = b.page AND cx BETWEEN x0 - 4 AND x1 + 4 AND cy BETWEEN y0 - 4 AND y1 + 4"),
    "box_reading_order": (box_reading_order, f"""WITH {PLACES_SQL}, j AS (SELECT p.page, box, line, round_even(cy / 8, 0) AS r, cx FROM points p JOIN boxes b ON p.page = b.page AND cx BETWEEN x0 - 4 AND x1 + 4 AND cy BETWEEN y0 - 4 AND y1 + 4),
        t AS (SELECT page, box, string_agg(CAST(line AS VARCHAR), ' ' ORDER BY r, cx, CAST(line AS VARCHAR)) AS t FROM j GROUP BY page, box) SELECT page, box, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n FROM t"""),
    "orphan_lines": (orphan_lines, f"WITH {DEALT_SQL} SELECT page, line FROM points p WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE p.page = b.page AND cx BETWEEN x0 - 4 AND x1 + 4 AND cy BETWEEN y0 - 4 AND y1 + 4)"),
    "next_block_below": (next_block_below, f"""WITH {DEALT_SQL} SELECT a.page, a.box AS line, arg_min(b.box, (b.y0, b.box)) FILTER (WHERE b.y0 > (a.y0 + a.y1) / 2 AND b.x0 < a.x1 AND b.x1 > a.x0) AS before
        FROM boxes a JOIN boxes b ON a.page = b.page GROUP BY a.page, a.box"""),
    "layout_obstacles": (layout_obstacles, f"""WITH {DEALT_SQL} SELECT a.page, a.box, min(b.y0 - a.y0) FILTER (WHERE a.box <> b.box AND a.x0 < b.x1 AND b.x0 < a.x1 AND b.y0 >= a.y0 + 0.6 * (a.y1 - a.y0)) AS allowed FROM boxes a JOIN boxes b ON a.page = b.page GROUP BY a.page, a.box"""),
    "style_mode": (style_mode, """WITH v AS (SELECT l_orderkey, l_returnflag || l_linestatus AS style, count(*) AS votes, min(l_linenumber) AS seen FROM lineitem GROUP BY ALL)
        SELECT l_orderkey, style, votes FROM v QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, seen, style) = 1"""),
    "word_span_overlap": (word_span_overlap, """WITH o AS (SELECT o_orderkey, o_orderkey % 20 AS s, o_orderkey % 20 + 9 AS e FROM orders), w AS (SELECT unnest(range(6)) AS i),
        h AS (SELECT o_orderkey, i * 60 + 50 * (greatest(s, i * 6) - i * 6) / 5 AS x0, i * 60 + 50 * (least(e, i * 6 + 5) - i * 6) / 5 AS x1 FROM o, w WHERE i * 6 + 5 > s AND i * 6 < e)
        SELECT o_orderkey, CAST(count(*) AS INTEGER) AS n, round(min(x0), 6) AS x0, round(max(x1), 6) AS x1 FROM h GROUP BY o_orderkey"""),
    "merge_rects": (merge_rects, None),
    "crop_grid": (crop_grid, """WITH p AS (SELECT p_partkey AS id, p_partkey % 50 AS x, p_size * 2 AS y, 160 + p_size * 4 AS side FROM part), s AS (SELECT unnest([1.0, 0.94, 1.06]::DOUBLE[]) AS scale), g AS (SELECT unnest(range(-4, 5)) AS i), h AS (SELECT unnest(range(-4, 5)) AS j),
        c AS (SELECT id, x + i * greatest(3, side // 24) AS nx, y + j * greatest(3, side // 24) AS ny, CAST(round_even(side * scale, 0) AS INTEGER) AS ns, abs(i * greatest(3, side // 24)) AS dx, abs(j * greatest(3, side // 24)) AS dy, side, scale FROM p, s, g, h)
        SELECT id, CAST(row_number() OVER w AS INTEGER) AS rank, CAST(nx AS INTEGER) AS x, CAST(ny AS INTEGER) AS y, ns AS side FROM c WHERE dx <= 1.6 * side / 8 AND dy <= 1.6 * side / 8 AND nx >= 0 AND ny >= 0 AND nx + ns <= 420 AND ny + ns <= 440
        WINDOW w AS (PARTITION BY id ORDER BY dx + dy + round(abs(scale - 1) * 100, 6), nx, ny, ns) QUALIFY row_number() OVER w <= 120"""),
    "gap_sessions": (gap_sessions, """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), n AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) <= 1800 THEN 0 ELSE 1 END AS new FROM e),
        i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS island FROM n) SELECT user_id, CAST(island AS INTEGER) AS island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY ALL"""),
    "coordinate_trend": (coordinate_trend, """WITH c AS (SELECT user_id, count(value) AS points, covar_pop(CAST(event_id AS DOUBLE), value) AS c, stddev_pop(CAST(event_id AS DOUBLE)) * stddev_pop(value) AS s FROM events GROUP BY user_id)
        SELECT user_id, points, CASE WHEN points >= 3 AND s <> 0 AND abs(c / s) >= 0.6 THEN CAST(sign(c / s) AS INTEGER) END AS trend FROM c"""),
    "vote_merge": (vote_merge, "SELECT user_id, CASE WHEN count(DISTINCT CASE WHEN value > 1 THEN event_type END) = 1 THEN min(CASE WHEN value > 1 THEN event_type END) END AS vote FROM events GROUP BY user_id"),
    "gap_split": (gap_split, """WITH p AS (SELECT user_id, value AS lo, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS hi FROM events WHERE value IS NOT NULL)
        SELECT user_id, round(max(hi - lo), 9) AS gap, round(arg_max((lo + hi) / 2, (hi - lo, lo)), 9) AS middle FROM p WHERE hi IS NOT NULL GROUP BY user_id"""),
    "upper_median": (upper_median, "SELECT source, count(n_chars) AS n, list_sort(list(n_chars))[1 + count(n_chars) // 2] AS median FROM documents GROUP BY source"),
}
