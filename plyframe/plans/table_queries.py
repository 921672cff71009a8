"""Queries over tokens, moves, corrections, reports and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LANGUAGES
from ..functions import geometry as G
from ..functions import text as T
from ..operators import blocks as K
from ..operators import spatial as S
from ..operators import tables as R
from ..operators import tokens as N
from ..streaming import progress
from .sources import GAMES_SQL, PLACES_SQL, _move_sql, boxes, games, points, printed_move, table


def tokenize_golden(spark, d):
    """The tokens of printed lines whose parts are known."""
    return N.tokens(games(spark, d), "en").select("page", "idx", "kind", "value")


def document_tokens(spark, d):
    """The tokens of all documents, each a page; no SQL, as the pattern looks ahead and back."""
    return N.tokens(table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text")), "en")


def variations_golden(spark, d):
    """Depth, ply and parent of the moves of printed lines with a variation."""
    pages = games(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page")  # texts are dealt, not their tokens
    return N.variations(N.tokens(pages, "en")).select("page", "idx", "value", "depth", "ply", "parent")


def _turn_tokens(spark, d):
    """Turns as tokens: the length of the text gives the kind."""
    kind = F.get(F.array(*[F.lit(k) for k in ("num", "move", "prose", "open", "close", "move", "num")]), (F.length("text") % 7).cast("int"))
    value = F.when(kind == "num", F.concat((F.length("text") % 3 + 1).cast("string"), F.lit("."))).when(kind == "open", "(").when(kind == "close", ")").otherwise("")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("idx"), kind.alias("kind"), value.alias("value"))


TURNS_SQL = """toks AS (SELECT conv_id AS page, CAST(turn AS INTEGER) AS idx, ['num', 'move', 'prose', 'open', 'close', 'move', 'num'][1 + length(text) % 7] AS kind,
    CASE WHEN length(text) % 7 IN (0, 6) THEN (length(text) % 3 + 1) || '.' WHEN length(text) % 7 = 3 THEN '(' WHEN length(text) % 7 = 4 THEN ')' ELSE '' END AS value FROM conversations)"""


def token_pairs(spark, d):
    return N.move_pairs(_turn_tokens(spark, d))


def token_runs(spark, d):
    return N.with_runs(_turn_tokens(spark, d)).select("page", "idx", "run", "trusted")


def bracket_depth(spark, d):
    return N.with_depth(_turn_tokens(spark, d)).select("page", "idx", "depth", "stray")


def stray_bracket(spark, d):
    return N.stray_close(_turn_tokens(spark, d))


def start_candidates(spark, d):
    moves = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("idx"), (F.col("turn") * 13 + F.col("conv_id") * 7).alias("ply"), F.when(F.col("role") == "user", 0).otherwise(1).alias("depth"))
    firsts = moves.where("idx = 0").select("page", "ply")
    return N.start_candidates(firsts, moves)


def page_band_join(spark, d):
    """Diagrams of pages within two pages of each page, nearest first."""
    return R.near_pages(table(spark, d, "pages").select(F.col("page_id").alias("page")), table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), "label"))


def to_san(spark, d):
    """French moves made from the parts' keys: castling, captures, promotions and plain ones."""
    i = F.col("p_partkey")
    move = printed_move(i, "CFTDR")
    made = F.when(i % 10 == 0, "0-0").when(i % 10 == 1, "0-0-0!").when(i % 10 == 2, F.concat(F.lit("e8="), F.substring(F.lit("CFTD"), (i % 4 + 1).cast("int"), F.lit(1)))).when(i % 10 == 3, F.concat(F.lit("ex"), F.substring(move, -2, 2))).otherwise(move)
    return table(spark, d, "part").select("p_partkey", T.to_san(made, "fr").alias("san"), T.plausible_lone(made, "fr").alias("lone"))


def edit_class(spark, d):
    name = F.col("p_brand")
    other = F.when(F.col("p_partkey") % 4 == 0, name).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("x"), name)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("?"), F.substring(name, 2, 50))).otherwise(F.substring(name, 2, 50))
    return table(spark, d, "part").select("p_partkey", T.edit_class(name, other).alias("kind"))


def mmss(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.mmss(F.col("o_totalprice")).alias("shown"))


def plural_message(spark, d):
    lang = F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("es")), (F.col("n_nationkey") % 3).cast("int"))
    n = F.col("n_regionkey")
    return table(spark, d, "nation").select("n_nationkey", T.plural(n, lang, F.concat(n.cast("string"), F.lit(" move")), F.concat(n.cast("string"), F.lit(" moves"))).alias("text"))


def ui_language(spark, d):
    setting = F.when(F.col("n_nationkey") % 4 == 0, F.lower(F.substring("n_name", 1, 2))).when(F.col("n_nationkey") % 4 == 1, F.lit("es"))
    system = F.array(F.concat(F.lower(F.substring("n_name", 1, 2)), F.lit("_XX")), F.when(F.col("n_regionkey") > 2, F.lit("fr_CA")).otherwise(F.lit("zz")))
    return table(spark, d, "nation").select("n_nationkey", T.language(setting, system, LANGUAGES).alias("lang"))


def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"), T.cache_key(F.col("text"), "v1").alias("cache_key"))


def member_names(spark, d):
    p = F.col("page_id")
    return table(spark, d, "pages").select("page_id", T.member_name("pages", p, ".json").alias("page"), T.row_id("p", p, "d", F.lit(1)).alias("id"), T.rgb_hex((p % 256).cast("int"), ((p * 7) % 256).cast("int"), F.lit(16)).alias("colour"))


def garbage_letters(spark, d):
    text = F.concat(F.lit("1.♕"), F.col("n_name"), F.lit("♞♞ e5"))
    letters = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("Q"), F.lit("N"))).otherwise(F.array(F.lit("Q")))
    return table(spark, d, "nation").select("n_nationkey", T.fill_garbage(text, letters).alias("text"), T.san_only(text).alias("san"))


def table_cells(spark, d):
    row = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c], F.lit("</tr>"))
    html = F.concat(row(F.lit("1"), F.col("n_name"), F.lit("...")), row(F.lit("2"), F.col("n_regionkey").cast("string"), F.col("n_name")))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.flatten(T.table_cells(html)), "|").alias("cells"))


def box_arithmetic(spark, d):
    b = G.box(F.col("p_size") * 1.5, F.col("p_size") * 2.0, F.col("p_size") * 4.5, F.col("p_size") * 3.0)
    wide, scaled, padded = G.widened(b), G.scaled(b, 200 / 72), G.padded(b, 2)
    presets = F.array(*[F.lit(float(x)) for x in (25, 50, 75, 100, 150, 200)])
    up, down = G.zoom_presets(F.col("p_size") * 4.0, presets)
    return table(spark, d, "part").select("p_partkey", F.round(wide["x0"], 6).alias("wide_x0"), scaled["x1"].alias("px"), G.area(padded).alias("area"), F.get(G.xywh(b), F.lit(2)).alias("w"), up.alias("zoom_in"), down.alias("zoom_out"))


def character_boxes(spark, d):
    boxes = G.character_boxes(F.col("n_name"), G.box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(10.0)))
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(boxes).alias("i", "b")).select("n_nationkey", "i", F.round("b.x0", 6).alias("x0"), F.round("b.x1", 6).alias("x1"))


def caption_blocks(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.lit(0).alias("ord"), F.when(F.col("doc_id") % 2 == 0, "figure_title").otherwise("text").alias("label"), (F.col("n_chars") % 3).alias("pairs"))
    return K.captions_to_text(rows, "pairs").select("page", "label")


def _corrections(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.concat(F.col("source"), F.lit(" w - - 0 1")).alias("fen"))
    made = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("target"), F.when(F.col("quality") == 1, "diagram_fen").otherwise("ignore").alias("type"), F.lit("fixed").alias("value"), T.content_hash(F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("fen"))).alias("source_hash"))
    return docs.withColumnRenamed("doc_id", "id"), made


def corrections_effective(spark, d):
    return R.effective(*_corrections(spark, d))


CORRECTIONS_SQL = """docs AS (SELECT doc_id AS id, source || ' w - - 0 1' AS fen FROM documents),
c AS (SELECT id, fen, CASE WHEN quality = 1 THEN 'diagram_fen' WHEN quality IS NOT NULL THEN 'ignore' END AS type, CASE WHEN l.doc_id IS NULL THEN NULL WHEN id % 5 = 0 THEN 'sha256:' || sha256('old') ELSE 'sha256:' || sha256(fen) END AS h FROM docs LEFT JOIN labels l ON id = l.doc_id)"""


def corrections_upsert(spark, d):
    _, made = _corrections(spark, d)
    new = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("target"), F.lit("diagram_fen").alias("type"), F.lit("again").alias("value"), F.lit("sha256:new").alias("source_hash"))
    return R.upserted(made, new, "target").select("target", "type", "value")


def page_report(spark, d):
    """The report of each conversation as a page: turns are moves, its vectors of the same number figures."""
    rows = table(spark, d, "conversations")
    moves = rows.select(F.col("conv_id").alias("page"), (F.col("role") == "assistant").alias("ok"), F.when(F.length("text") % 3 > 0, F.array(F.lit(1))).alias("rects"))
    figures = table(spark, d, "embeddings").select((F.col("vec_id") % 150).alias("page"), F.when(F.col("label") < 6, "x").alias("fen"), F.when(F.col("label") < 3, "y").alias("matches"))
    return R.page_report(rows.select(F.col("conv_id").alias("page")), moves, figures)


def agreement_ratio(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("doc_id") % 4 > 0, F.col("quality")).alias("a"), F.when(F.col("doc_id") % 3 > 0, F.col("toxic")).alias("b"))
    return R.agreement(rows, "a", "b")


def message_keys(spark, d):
    """Nations as messages in three languages, some of which lack one or differ in a placeholder."""
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "es")]))
    rows = table(spark, d, "nation").select(F.col("n_name").alias("key"), "n_nationkey", langs.alias("lang"))
    rows = rows.where("not (n_nationkey % 5 = 0 and lang = 'fr')").withColumn("text", F.when((F.col("n_nationkey") % 7 == 0) & (F.col("lang") == "es"), "{n} of {m}").otherwise("{m} and {n}"))
    rows = rows.withColumn("text", F.when((F.col("n_nationkey") % 6 == 0) & (F.col("lang") == "en"), "{n}").otherwise(F.col("text")))
    return R.broken_keys(rows, LANGUAGES)


def progress_latest(spark, d):
    line = F.concat_ws("\t", F.lit("@@PROGRESS"), F.col("event_type"), F.col("event_id").cast("string"), F.lit("20000"), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return progress.latest(progress.parsed(table(spark, d, "events").select(line.alias("value"))))


def resume_anti(spark, d):
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("page"))
    return R.unfinished(table(spark, d, "documents").select(F.col("doc_id").alias("page")), done)


def unioned_sources(spark, d):
    text = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.lit("text").alias("label"), F.col("n_chars"))
    image = table(spark, d, "embeddings").select(F.col("vec_id").alias("page"), F.lit("image").alias("label"), F.col("label").alias("kind"))
    return R.stacked(text, image)


def text_styles(spark, d):
    """Styles of the orders' boxes as printed lines: the most frequent one of the text objects that stand in them."""
    font = F.concat(F.col("l_returnflag"), F.when(F.col("l_quantity") > 25, "-SemiBold").when(F.col("l_quantity") > 20, "-BLACK").otherwise("-Roman"))
    marks = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), font.alias("font"), (F.col("l_quantity") % 2 * 255).cast("int").alias("red"))
    objects = points(spark, d).join(marks, "line").select("page", F.col("line").alias("seq"), "cx", "cy", "font", "red", F.lit(0).alias("green"), F.lit(16).alias("blue"))
    return S.line_styles(objects, boxes(spark, d)).select("page", "box", "bold", "color")


QUERIES = {
    "tokenize_golden": (tokenize_golden, f"""WITH {GAMES_SQL}, t AS (SELECT page, [('num', n || '.'), ('move', m[1]), ('move', m[2]), ('num', (n + 1) || '.'), ('move', m[3]), ('open', '('), ('num', (n + 1) || '.'), ('move', m[4]), ('move', m[5]), ('close', ')'),
            ('num', (n + 1) || '...'), ('move', m[6]), ('prose', ''), ('semi', ';'), ('num', (n + 2) || '.'), ('move', m[7]), ('move', m[8]), ('res', '1-0')] AS l FROM games), u AS (SELECT page, l, unnest(range(len(l))) AS i FROM t)
        SELECT page, CAST(i AS INTEGER) AS idx, l[i + 1][1] AS kind, l[i + 1][2] AS value FROM u"""),
    "document_tokens": (document_tokens, None),
    "variations_golden": (variations_golden, f"""WITH {GAMES_SQL}, t AS (SELECT page, n, m, unnest([[1, 1, 0, 0, NULL], [2, 2, 0, 1, 1], [4, 3, 0, 2, 2], [7, 4, 1, 2, 4], [8, 5, 1, 3, 7], [11, 6, 0, 3, 4], [15, 7, 0, 4, 11], [16, 8, 0, 5, 15]]) AS r FROM games)
        SELECT page, CAST(r[1] AS INTEGER) AS idx, m[r[2]] AS value, CAST(r[3] AS INTEGER) AS depth, CAST(2 * (n - 1) + r[4] AS INTEGER) AS ply, CAST(r[5] AS INTEGER) AS parent FROM t"""),
    "token_pairs": (token_pairs, f"""WITH {TURNS_SQL}, n AS (SELECT *, lead(kind) OVER (PARTITION BY page ORDER BY idx) AS nk FROM toks)
        SELECT page, count_if(kind = 'num' AND nk = 'move') AS pairs, coalesce(bool_or(kind = 'num' AND nk = 'move' AND value = '1.'), false) AS starts FROM n GROUP BY page"""),
    "token_runs": (token_runs, f"""WITH {TURNS_SQL}, r AS (SELECT *, CAST(sum(CAST(kind = 'prose' AS INTEGER)) OVER (PARTITION BY page ORDER BY idx) AS INTEGER) AS run FROM toks)
        SELECT page, idx, run, max(kind = 'num') OVER (PARTITION BY page, run ORDER BY idx) AS trusted FROM r"""),
    "bracket_depth": (bracket_depth, f"""WITH {TURNS_SQL}, s AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page ORDER BY idx) AS level FROM toks),
        m AS (SELECT *, least(0, min(level) OVER (PARTITION BY page ORDER BY idx)) AS low FROM s) SELECT page, idx, CAST(level - low AS INTEGER) AS depth, low < coalesce(lag(low) OVER (PARTITION BY page ORDER BY idx), 0) AS stray FROM m"""),
    "stray_bracket": (stray_bracket, f"""WITH {TURNS_SQL}, s AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page ORDER BY idx) AS level FROM toks),
        m AS (SELECT *, least(0, min(level) OVER (PARTITION BY page ORDER BY idx)) AS low FROM s), f AS (SELECT page, min(idx) AS idx FROM m WHERE low = -1 GROUP BY page),
        e AS (SELECT f.page, f.idx, max(m.idx) AS early FROM f JOIN m ON m.page = f.page AND m.idx < f.idx AND m.kind = 'close' AND m.level = 0 AND m.low = 0 GROUP BY ALL) SELECT page, idx, early FROM e WHERE idx - early <= 60"""),
    "start_candidates": (start_candidates, """WITH m AS (SELECT conv_id AS page, turn AS idx, turn * 13 + conv_id * 7 AS ply, role FROM conversations)
        SELECT f.page, m.page AS other, m.idx, abs(m.page - f.page) AS away, CAST(row_number() OVER (PARTITION BY f.page ORDER BY abs(m.page - f.page), m.page, m.idx) AS INTEGER) AS rank FROM m JOIN m f ON f.idx = 0 AND f.ply = m.ply + 1 AND m.role = 'user' AND f.page <> m.page"""),
    "page_band_join": (page_band_join, "SELECT page_id AS page, vec_id AS q, abs(vec_id - page_id) AS away, label FROM pages JOIN embeddings ON abs(vec_id - page_id) <= 2"),
    "to_san": (to_san, f"""WITH p AS (SELECT p_partkey AS i, {_move_sql('p_partkey', 'CFTDR')} AS fr, {_move_sql('p_partkey', 'NBRQK')} AS en FROM part)
        SELECT i AS p_partkey, CASE i % 10 WHEN 0 THEN 'O-O' WHEN 1 THEN 'O-O-O' WHEN 2 THEN 'e8=' || substr('NBRQ', CAST(1 + i % 4 AS INTEGER), 1) WHEN 3 THEN rtrim('ex' || right(en, 2), '!?') ELSE rtrim(en, '!?') END AS san,
               i % 10 <= 3 OR i % 6 > 0 OR i % 4 >= 2 AS lone FROM p"""),
    "edit_class": (edit_class, """WITH p AS (SELECT p_partkey, p_brand AS a, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'x' || p_brand WHEN 2 THEN '?' || substr(p_brand, 2) ELSE substr(p_brand, 2) END AS b FROM part)
        SELECT p_partkey, CASE WHEN a = b THEN 0 WHEN levenshtein(a, b) = 1 AND length(b) = length(a) + 1 THEN 1 WHEN levenshtein(a, b) = 1 AND length(a) = length(b) THEN 2 END AS kind FROM p"""),
    "mmss": (mmss, "SELECT o_orderkey, printf('%02d:%02d', CAST(trunc(o_totalprice) AS BIGINT) // 60, CAST(trunc(o_totalprice) AS BIGINT) % 60) AS shown FROM orders"),
    "plural_message": (plural_message, "SELECT n_nationkey, n_regionkey || CASE WHEN n_nationkey % 3 = 1 AND n_regionkey < 2 OR n_regionkey = 1 THEN ' move' ELSE ' moves' END AS text FROM nation"),
    "ui_language": (ui_language, """WITH n AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name[1:2]) WHEN 1 THEN 'es' END AS setting, lower(n_name[1:2]) AS a, CASE WHEN n_regionkey > 2 THEN 'fr' ELSE 'zz' END AS b FROM nation)
        SELECT n_nationkey, CASE WHEN setting IN ('en', 'fr', 'es') THEN setting WHEN a IN ('en', 'fr', 'es') THEN a WHEN b IN ('en', 'fr', 'es') THEN b ELSE 'en' END AS lang FROM n"""),
    "content_hashes": (content_hashes, "SELECT doc_id, 'sha256:' || sha256(text) AS hash, 'v1_' || sha256(text) AS cache_key FROM documents"),
    "member_names": (member_names, "SELECT page_id, printf('pages/p%04d.json', page_id) AS page, 'p' || page_id || '_d1' AS id, printf('#%02x%02x10', page_id % 256, (page_id * 7) % 256) AS colour FROM pages"),
    "garbage_letters": (garbage_letters, """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '1.Q' || n_name || 'N e5' ELSE '1.♕' || n_name || '♞♞ e5' END AS text, regexp_replace('1.' || n_name || ' e5', '[^a-h1-8xNBRQKO0=+#-]', '', 'g') AS san FROM nation"""),
    "table_cells": (table_cells, "SELECT n_nationkey, n_name || '|' || n_regionkey || '|' || n_name AS cells FROM nation"),
    "box_arithmetic": (box_arithmetic, """SELECT p_partkey, round(CAST(p_size * 1.5 - 0.22 * p_size AS DOUBLE), 6) AS wide_x0, CAST(round_even(p_size * 4.5 * (200 / 72), 0) AS INTEGER) AS px, CAST((p_size * 3 + 4) * (p_size + 4) AS DOUBLE) AS area, CAST(p_size * 3 AS DOUBLE) AS w,
        coalesce(list_min(list_filter([25, 50, 75, 100, 150, 200], lambda p: p > p_size * 4 + 0.5)), 200)::DOUBLE AS zoom_in, coalesce(list_max(list_filter([25, 50, 75, 100, 150, 200], lambda p: p < p_size * 4 - 0.5)), 25)::DOUBLE AS zoom_out FROM part"""),
    "character_boxes": (character_boxes, "SELECT n_nationkey, CAST(i AS INTEGER) AS i, round(100.0 * i / n, 6) AS x0, round(100.0 * (i + 1) / n, 6) AS x1 FROM (SELECT n_nationkey, length(n_name) AS n, unnest(range(length(n_name))) AS i FROM nation)"),
    "caption_blocks": (caption_blocks, "SELECT doc_id AS page, CASE WHEN doc_id % 2 = 0 AND n_chars % 3 = 0 THEN 'figure_title' ELSE 'text' END AS label FROM documents"),
    "corrections_effective": (corrections_effective, f"""WITH {CORRECTIONS_SQL} SELECT id, CASE WHEN type = 'diagram_fen' AND h = 'sha256:' || sha256(fen) THEN 'fixed' ELSE fen END AS value, coalesce(type = 'diagram_fen' AND h = 'sha256:' || sha256(fen), false) AS corrected,
        coalesce(type = 'diagram_fen' AND h <> 'sha256:' || sha256(fen), false) AS needs_review FROM c"""),
    "corrections_upsert": (corrections_upsert, f"""WITH {CORRECTIONS_SQL} SELECT id AS target, CASE WHEN id % 3 = 0 THEN 'diagram_fen' ELSE type END AS type, CASE WHEN id % 3 = 0 THEN 'again' ELSE 'fixed' END AS value FROM c WHERE type IS NOT NULL OR id % 3 = 0"""),
    "page_report": (page_report, """WITH m AS (SELECT conv_id AS page, count_if(role = 'assistant') AS moves, count_if(role <> 'assistant') AS illegal, count_if(length(text) % 3 > 0) AS located FROM conversations GROUP BY ALL), f AS (SELECT vec_id % 150 AS page, count(*) AS figures, count_if(label < 6) AS read, count_if(label < 3) AS matched FROM embeddings GROUP BY ALL),
        j AS (SELECT page, moves, illegal, located, coalesce(figures, 0) AS figures, coalesce(read, 0) AS read, coalesce(matched, 0) AS matched FROM m LEFT JOIN f USING (page))
        SELECT *, moves || ' moves' || CASE WHEN located > 0 THEN ', ' || located || ' located' ELSE '' END || CASE WHEN illegal > 0 THEN ', ' || illegal || ' illegal' ELSE '' END || CASE WHEN figures > 0 THEN ', ' || figures || ' figures' ELSE '' END || CASE WHEN read > 0 THEN ', ' || read || ' read' ELSE '' END || CASE WHEN matched > 0 THEN ', ' || matched || ' matched' ELSE '' END AS line FROM j"""),
    "agreement_ratio": (agreement_ratio, "SELECT count_if(doc_id % 4 > 0 AND doc_id % 3 > 0 AND quality = toxic) AS agree, count_if(doc_id % 4 > 0 AND doc_id % 3 > 0 AND quality IS NOT NULL AND toxic IS NOT NULL) AS total FROM labels"),
    "message_keys": (message_keys, """SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'fr' ELSE '' END AS missing, CASE WHEN n_nationkey % 6 = 0 THEN 2 ELSE 1 END AS placeholders FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 6 = 0"""),
    "progress_latest": (progress_latest, """SELECT event_type AS label, CAST(max(event_id) AS INTEGER) AS i, 20000 AS n, arg_max('u' || user_id, event_id) AS note, max(event_id) / 20000 AS share FROM events GROUP BY event_type"""),
    "resume_anti": (resume_anti, "SELECT doc_id AS page FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    "unioned_sources": (unioned_sources, "SELECT 0 AS source, doc_id AS page, 'text' AS label, n_chars, CAST(NULL AS INTEGER) AS kind FROM documents UNION ALL SELECT 1, vec_id, 'image', NULL, label FROM embeddings"),
    "text_styles": (text_styles, f"""WITH {PLACES_SQL}, m AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_quantity > 20 AS bold, printf('#%02x0010', CAST(l_quantity AS INTEGER) % 2 * 255) AS color FROM lineitem),
        v AS (SELECT p.page, box, bold, color, count(*) AS votes, min(line) AS seen FROM points p JOIN m USING (line) JOIN boxes b ON p.page = b.page AND cx BETWEEN x0 - 1 AND x1 + 1 AND cy BETWEEN y0 - 1 AND y1 + 1 GROUP BY ALL)
        SELECT page, box, bold, color FROM v QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY votes DESC, seen, bold, color) = 1"""),
}
