"""Queries of pages: run-on cascade, printed coordinates, pictures, glued numbers, matches and groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import DEDUPE_WINDOWS
from ..functions import geometry as G
from ..functions import text as T
from ..operators import blocks as K
from ..operators import positions as P
from ..operators import reader, series
from ..operators import spatial as S
from ..operators import tables as R
from ..operators import tokens as N
from .. import sql
from ..operators import images as I
from ..sources import cache, layer, shared
from ..streaming import progress
from .sources import BLOCKS_SQL, BOARDS_SQL, DEALT_SQL, PLACES_SQL, blocks, boards, boxes, games, points, table
from .table_queries import QUERIES as TABLE_SQL
from .table_queries import TURNS_SQL, _turn_tokens


def dedupe_cascade(spark, d):
    """Blocks that run on into the next one, some with misread first words, some as markup, cut again; texts without white space."""
    after = F.lead("text").over(Window.partitionBy("page").orderBy("ord"))
    misread = F.concat(F.col("text"), F.lit(" zzzz"), F.substring(after, F.lit(9), F.length(after)))
    run_on = F.when(F.col("ord") % 4 == 0, F.concat_ws(" ", F.col("text"), after)).when(F.col("ord") % 4 == 2, F.coalesce(misread, F.col("text"))).otherwise(F.col("text"))
    cells = F.concat(F.lit("<table><tr>\n<td>"), F.replace("text", F.lit(" "), F.lit("</td> <td>")), F.lit("</td></tr></table>"))
    marked = F.when((F.col("ord") % 5 == 0) & (F.col("label") == "text") & ~F.col("text").rlike("[<>&]"), cells).otherwise(F.col("text"))
    made = blocks(spark, d).select("page", "ord", F.when(F.col("ord") % 7 == 6, "image").otherwise("text").alias("label"), run_on.alias("text")).withColumn("text", marked)
    return K.dedupe(made).select("page", "ord", F.length(T.squash(F.col("text"))).alias("n"), F.md5(T.squash(F.col("text"))).alias("flat_md5"))


def _cascade_sql() -> str:
    at = [f"CASE WHEN length(x) >= {skip + size} THEN instr(acc, substr(x, {skip + 1}, {size})) - 1 ELSE -1 END" for skip, size in DEDUPE_WINDOWS]
    cases = " ".join(f"WHEN ({a}) > {skip} THEN substr(acc, 1, ({a}) - {skip}) WHEN ({a}) IN (0, {skip}) THEN acc" for a, (skip, _) in zip(at, DEDUPE_WINDOWS, strict=True))
    return f"CASE {cases} ELSE acc END"


def token_previous(spark, d):
    """The three tokens before each one."""
    before = N.with_previous(_turn_tokens(spark, d))
    return before.select("page", "idx", F.array_join(F.transform("before", lambda b: F.concat(b["kind"], F.lit(":"), b["value"])), "|").alias("before"))


def lateral_tokens(spark, d):
    """The tokens of printed lines by the SQL table function."""
    sql.register(spark)
    games(spark, d).createOrReplaceTempView("_printed_games")
    return spark.sql("SELECT page, t.idx, t.kind, t.value FROM _printed_games, LATERAL book_tokens_en(text) AS t")


def lateral_moves(spark, d):
    """The moves of printed lines with depth and ply by the SQL table function."""
    sql.register(spark)
    games(spark, d).createOrReplaceTempView("_printed_games")
    return spark.sql("SELECT page, t.idx, t.value, t.depth, t.ply FROM _printed_games, LATERAL book_moves_en(text) AS t")


def block_move_ids(spark, d):
    """The spans that each line of a document holds, as its moves."""
    rows = blocks(spark, d)
    spans = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.explode(F.sequence(F.lit(0), F.length("text").cast("long"), F.lit(37))).alias("s")).withColumn("e", F.col("s") + 5)
    placed = S.spans_in_blocks(spans, K.with_offsets(rows)).withColumn("id", F.concat_ws("_m", F.concat(F.lit("p"), F.col("page")), F.floor(F.col("s") / 37)))
    return K.block_moves(rows, placed).select("page", "ord", F.array_join("moves", ",").alias("moves"))


def block_list_scan(spark, d):
    """Blocks written as a JSON list for each page and read again."""
    one = F.struct(F.col("label").alias("block_label"), F.col("text").alias("block_content"), F.array(*[F.col(f"bbox.{k}").cast("int") for k in ("x0", "y0", "x1", "y1")]).alias("block_bbox"))
    lists = blocks(spark, d).groupBy("page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("b")))), lambda r: r["b"])).alias("json"))
    folder = shared.folder(spark, "lists")
    I.saved(lists.select(F.concat(F.lit("p"), F.col("page"), F.lit(".json")).alias("name"), F.encode("json", "UTF-8").alias("bytes")), folder)
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page")).distinct()
    return layer.block_lists(spark, folder, pages=pages).select("page", "ord", "label", F.md5("text").alias("text_md5"), F.col("bbox.y1").alias("y1"))


def cached_words(spark, d):
    """Words of documents from the store of results: those of every second one are computed by a call before."""
    count = lambda rows: rows.select("key", T.n_words(F.col("text")).alias("words"))
    docs, folder = table(spark, d, "documents").select("doc_id", "text"), shared.folder(spark, "words")
    cache.through(docs.where("doc_id % 2 = 0"), F.col("text"), folder, "v1", count).count()
    return cache.through(docs, F.col("text"), folder, "v1", count).select("doc_id", "words")


def figure_blocks(spark, d):
    return K.figures(blocks(spark, d)).select("page", "ord", "label")


def first_objects(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object"))
    return K.first_objects(rows, "object").groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.max("object").alias("last"))


def fill_moves(spark, d):
    label = F.get(F.array(*[F.lit(x) for x in ("text", "paragraph_title", "figure_title", "header")]), (F.col("doc_id") % 4).cast("int"))
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("page"), F.lit(0).alias("ord"), label.alias("label"), F.col("source").alias("text"), (F.col("n_chars") % 3).alias("pairs"))
    again = docs.where("doc_id % 5 > 0").select(F.col("doc_id").alias("page"), F.lit(0).alias("ord"), F.concat(F.lit(" "), F.col("lang")).alias("again"), (F.col("n_chars") % 5).alias("again_pairs"))
    return K.refill_moves(rows, again)


def glued_numbers(spark, d):
    toks = _turn_tokens(spark, d).withColumn("start", F.col("idx") * 10).withColumn("end", F.when((F.col("kind") == "num") & (F.col("page") % 2 == 0), F.col("start") + 10).otherwise(F.col("start") + 5))
    return N.shown_spans(toks).select("page", "idx", "shown_from")


def matched_positions(spark, d):
    diagrams = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("book"), F.concat(F.lit("m"), (F.col("vec_id") % 700).cast("string")).alias("matches"))
    moves = table(spark, d, "conversations").where("turn = 0").select((F.col("conv_id") % 3).alias("book"), F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("id"), F.md5("text").alias("fen"))
    return P.full_positions(diagrams, moves).select("vec_id", "full")


def training_filter(spark, d):
    rows = boards(spark, d).withColumn("truth", F.when(F.col("id") % 5 == 0, F.reverse("cells")).otherwise(F.col("cells")))
    return P.training_rows(rows, (1, 4)).select("id", "held")


def first_best_crop(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("score"))
    return P.first_best(rows, "user_id", "score", "event_id")


def page_bounds(spark, d):
    return series.page_bounds(table(spark, d, "documents").select("source", F.col("doc_id").alias("page")), "source")


def least_font(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("page"), "l_orderkey", "l_linenumber", "l_quantity")
    return series.least_of_page(rows, "l_quantity").select("l_orderkey", "l_linenumber", "least")


def tiles_by_piece(spark, d):
    rows = table(spark, d, "part").select("p_brand", (F.col("p_size") % 2).alias("parity"), "p_partkey")
    return series.grouped(rows, ("p_brand", "parity"), "p_partkey").select("p_brand", "parity", F.size("values").alias("n"), F.array_join(F.col("values").cast("array<string>"), ",").alias("keys"))


def cell_pairs(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"), F.split("role", "").alias("c"))
    pairs = reader.zipped(F.col("w"), F.col("c"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(pairs, lambda p: F.concat(p["left"], F.lit(":"), p["right"])), "|").alias("pairs"))


def _pieces(spark, d):
    sign = F.substring(F.lit("12345678abcdefghX"), (F.col("line") % 17 + 1).cast("int"), F.lit(1))
    return points(spark, d, dealt=True).withColumn("text", F.when(F.col("line") % 5 == 0, F.concat(sign, sign)).otherwise(sign))


def _diagrams(spark, d):
    return boxes(spark, d, dealt=True).withColumn("bbox", G.box(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x0") + 300.0, F.col("bbox.y0") + 900.0))


def coordinate_evidence(spark, d):
    return S.coordinate_evidence(_pieces(spark, d), _diagrams(spark, d))


def printed_orientation(spark, d):
    return S.printed_orientation(_pieces(spark, d), _diagrams(spark, d))


def orphan_moves(spark, d):
    """Lines as boxes of 60 x 40 around their points, on pages with the orders' boxes."""
    lines = points(spark, d).withColumn("bbox", G.box(F.col("cx") - 30, F.col("cy") - 20, F.col("cx") + 30, F.col("cy") + 20)).withColumn("has_moves", F.col("line") % 3 > 0)
    return S.orphan_moves(lines, boxes(spark, d))


def printed_pictures(spark, d):
    rows = boxes(spark, d).select("page", F.col("bbox.x0").alias("x"), F.col("bbox.y0").alias("y"), (50 + F.col("box") % 3 * 400).alias("width"), (60 + F.col("box") % 5 * 300).alias("height"), F.lit(1_000_000).alias("page_area"), (F.col("box") * 1000).alias("pixels"))
    return S.printed_pictures(rows)


def book_titles(spark, d):
    page = table(spark, d, "pages")
    given = F.when(F.col("page_id") % 7 == 0, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Given "), F.col("page_id").cast("string"))).otherwise(""))
    title = F.when(F.col("page_id") % 3 > 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return R.titled(page.select(F.col("page_id").alias("book"), F.col("url").alias("path"), given.alias("given"), title.alias("title")))


def overall_progress(spark, d):
    """Users as runs, their events as steps; errors of every third user end the run."""
    code = F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), (F.col("event_id") % 2).cast("int"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.col("event_type").alias("label"), code.alias("code"))
    return progress.overall(rows, ("view", "click", "signup", "purchase"))


_PIECES_SQL = f"""{DEALT_SQL}, pieces AS (SELECT *, repeat(substr('12345678abcdefghX', CAST(line % 17 + 1 AS INTEGER), 1), CASE WHEN line % 5 = 0 THEN 2 ELSE 1 END) AS t FROM points),
    held AS (SELECT p.page, b.box, t, cx, cy, x0, y0, x0 + 300 AS x9, y0 + 900 AS y9 FROM pieces p JOIN boxes b ON p.page = b.page AND cx BETWEEN x0 AND x0 + 300 AND cy BETWEEN y0 AND y0 + 900),
    evidence AS (SELECT page, box, 'rank' AS axis, cy AS position, CAST(t AS INTEGER) AS value FROM held WHERE regexp_full_match(t, '[1-8]') AND (cx < x0 + 0.15::DOUBLE * 300 OR cx > x9 - 0.15::DOUBLE * 300)
        UNION ALL SELECT page, box, 'file', cx, CAST(ascii(t) - 97 AS INTEGER) FROM held WHERE regexp_full_match(t, '[a-h]') AND (cy < y0 + 0.15::DOUBLE * 900 OR cy > y9 - 0.15::DOUBLE * 900))"""

QUERIES = {
    "dedupe_cascade": (dedupe_cascade, f"""WITH {BLOCKS_SQL}, n AS (SELECT page, ord, text, lead(text) OVER (PARTITION BY page ORDER BY ord) AS after FROM blocks),
        r AS (SELECT page, ord, ord % 7 <> 6 AS book, regexp_replace(CASE WHEN ord % 4 = 0 THEN concat_ws(' ', text, after) WHEN ord % 4 = 2 THEN coalesce(text || ' zzzz' || substr(after, 9), text) ELSE text END, '\\s+', '', 'g') AS flat FROM n),
        l AS (SELECT a.page, a.ord, a.book, a.flat, coalesce(list(b.flat ORDER BY b.ord) FILTER (WHERE b.flat IS NOT NULL), []) AS later FROM r a LEFT JOIN r b ON a.book AND b.book AND a.page = b.page AND b.ord > a.ord AND length(b.flat) >= 12 GROUP BY ALL),
        c AS (SELECT page, ord, list_reduce([flat] || later, lambda acc, x: {_cascade_sql()}) AS t FROM l) SELECT page, ord, CAST(length(t) AS INTEGER) AS n, md5(t) AS flat_md5 FROM c"""),
    "token_previous": (token_previous, f"""WITH {TURNS_SQL}, w AS (SELECT page, idx, [lag(kind || ':' || value, 1) OVER w, lag(kind || ':' || value, 2) OVER w, lag(kind || ':' || value, 3) OVER w] AS l FROM toks WINDOW w AS (PARTITION BY page ORDER BY idx))
        SELECT page, idx, array_to_string(list_filter(l, lambda x: x IS NOT NULL), '|') AS before FROM w"""),
    "lateral_tokens": (lateral_tokens, TABLE_SQL["tokenize_golden"][1]),
    "lateral_moves": (lateral_moves, f"SELECT page, idx, value, depth, ply FROM ({TABLE_SQL['variations_golden'][1]})"),
    "block_move_ids": (block_move_ids, f"""WITH {BLOCKS_SQL}, o AS (SELECT page, ord, CAST(sum(length(text) + 1) OVER (PARTITION BY page ORDER BY ord) - length(text) - 1 AS BIGINT) AS a, length(text) AS n FROM blocks),
        s AS (SELECT doc_id AS page, unnest(range(0, length(text) + 1, 37)) AS s FROM documents)
        SELECT o.page, ord, coalesce(string_agg('p' || s.page || '_m' || (s // 37), ',' ORDER BY s), '') AS moves FROM o LEFT JOIN s ON s.page = o.page AND a <= s AND s + 5 <= a + n GROUP BY o.page, ord"""),
    "block_list_scan": (block_list_scan, f"WITH {BLOCKS_SQL} SELECT page, ord, label, md5(text) AS text_md5, CAST(y1 AS INTEGER) AS y1 FROM blocks WHERE label IN ('text', 'paragraph_title')"),
    "cached_words": (cached_words, "SELECT doc_id, CAST(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END AS INTEGER) AS words FROM documents"),
    "figure_blocks": (figure_blocks, f"WITH {BLOCKS_SQL} SELECT page, ord, label FROM blocks WHERE label IN ('image', 'chart', 'seal')"),
    "first_objects": (first_objects, """WITH r AS (SELECT l_linenumber AS page, l_orderkey * 10 + l_linenumber AS object FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey * 10 + l_linenumber) <= 20000)
        SELECT page, count(*) AS n, max(object) AS last FROM r GROUP BY page"""),
    "fill_moves": (fill_moves, """WITH t AS (SELECT doc_id AS page, ['text', 'paragraph_title', 'figure_title', 'header'][1 + doc_id % 4] AS label, source, lang, n_chars % 3 AS pairs, CASE WHEN doc_id % 5 > 0 THEN n_chars % 5 END AS again FROM documents),
        m AS (SELECT *, coalesce(label <> 'header' AND again > pairs, false) AS refilled FROM t)
        SELECT page, 0 AS ord, CASE WHEN refilled AND label <> 'paragraph_title' OR label = 'figure_title' AND CASE WHEN refilled THEN again ELSE pairs END > 0 THEN 'text' ELSE label END AS label,
               CASE WHEN refilled THEN lang ELSE source END AS text, CASE WHEN refilled THEN again ELSE pairs END AS pairs, refilled FROM m"""),
    "glued_numbers": (glued_numbers, f"""WITH {TURNS_SQL}, s AS (SELECT *, idx * 10 AS a, CASE WHEN kind = 'num' AND page % 2 = 0 THEN idx * 10 + 10 ELSE idx * 10 + 5 END AS e FROM toks)
        SELECT page, idx, CASE WHEN kind = 'move' AND lag(kind) OVER w = 'num' AND lag(e) OVER w = a THEN lag(a) OVER w ELSE a END AS shown_from FROM s WINDOW w AS (PARTITION BY page ORDER BY idx)"""),
    "matched_positions": (matched_positions, """WITH m AS (SELECT conv_id % 3 AS book, 'm' || conv_id AS id, md5(text) AS fen FROM conversations WHERE turn = 0)
        SELECT vec_id, fen AS "full" FROM embeddings e LEFT JOIN m ON vec_id % 3 = book AND 'm' || (vec_id % 700) = id"""),
    "training_filter": (training_filter, f"WITH {BOARDS_SQL} SELECT id, book IN (1, 4) AS held FROM boards WHERE hamming(read, CASE WHEN id % 5 = 0 THEN reverse(cells) ELSE cells END) <= 12"),
    "first_best_crop": (first_best_crop, "WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS score FROM events WHERE value IS NOT NULL) SELECT user_id, max(score) AS score, arg_max(event_id, (score, -event_id)) AS event_id FROM e GROUP BY user_id"),
    "page_bounds": (page_bounds, 'SELECT source, min(doc_id) AS "first", max(doc_id) AS "last" FROM documents GROUP BY source'),
    "least_font": (least_font, "SELECT l_orderkey, l_linenumber, min(l_quantity) OVER (PARTITION BY l_orderkey % 500) AS least FROM lineitem"),
    "tiles_by_piece": (tiles_by_piece, "SELECT p_brand, p_size % 2 AS parity, CAST(count(*) AS INTEGER) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS keys FROM part GROUP BY ALL"),
    "cell_pairs": (cell_pairs, """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w, role FROM conversations)
        SELECT conv_id, turn, array_to_string(list_transform(range(least(len(w), length(role))), lambda i: w[i + 1] || ':' || substr(role, i + 1, 1)), '|') AS pairs FROM w"""),
    "coordinate_evidence": (coordinate_evidence, f"WITH {_PIECES_SQL} SELECT * FROM evidence"),
    "printed_orientation": (printed_orientation, f"""WITH {_PIECES_SQL}, c AS (SELECT page, box, axis, count(*) AS n, covar_pop(position, value) AS c, stddev_pop(position) * stddev_pop(value) AS s FROM evidence GROUP BY ALL),
        v AS (SELECT page, box, CASE WHEN n >= 3 AND s <> 0 AND abs(c / s) >= 0.6 THEN (c > 0) = (axis = 'rank') END AS vote FROM c), a AS (SELECT page, box, CASE WHEN min(vote) = max(vote) THEN min(vote) END AS flipped FROM v GROUP BY ALL)
        SELECT b.page, b.box, flipped FROM boxes b LEFT JOIN a ON b.page = a.page AND b.box = a.box"""),
    "orphan_moves": (orphan_moves, None),
    "printed_pictures": (printed_pictures, f"""WITH {PLACES_SQL}, p AS (SELECT page, x0 AS x, y0 AS y, 50 + box % 3 * 400 AS width, 60 + box % 5 * 300 AS height, max(box * 1000) AS pixels FROM boxes GROUP BY ALL)
        SELECT *, CAST(row_number() OVER w AS INTEGER) AS number, pixels BETWEEN 1 AND 40000000 AS extracted FROM p WHERE width * height < 800000 WINDOW w AS (PARTITION BY page ORDER BY round_even(y / 100, 0), x, y, width, height) QUALIFY row_number() OVER w <= 60"""),
    "book_titles": (book_titles, """WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'Given ' || page_id ELSE '' END END AS given,
            CASE WHEN page_id % 3 > 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS meta, list_last(list_filter(string_split(url, '/'), lambda x: x <> '')) AS name FROM pages)
        SELECT page_id AS book, coalesce(nullif(given, ''), nullif(meta, ''), regexp_replace(name, '^(.+)\\.[^.]+$', '\\1', 's')) AS title FROM p"""),
    "overall_progress": (overall_progress, """WITH e AS (SELECT user_id, event_id, CAST(nullif(list_position(['view', 'click', 'signup', 'purchase'], event_type), 0) AS INTEGER) AS k,
            CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN CAST(event_id % 2 AS INTEGER) END AS code FROM events),
        r AS (SELECT user_id AS run, arg_max(k, event_id) FILTER (WHERE k IS NOT NULL) AS stage, max(event_id) - min(event_id) AS s, arg_max(code, event_id) FILTER (WHERE code IS NOT NULL) AS code FROM e GROUP BY user_id)
        SELECT run, stage, 4 AS steps, CASE WHEN s // 60 < 10 THEN '0' ELSE '' END || (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
               CASE WHEN code IS NULL THEN 'running' WHEN code = 0 THEN 'done' ELSE 'stopped' END AS state, code FROM r"""),
}
