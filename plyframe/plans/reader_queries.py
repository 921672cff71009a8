"""Queries of the reader's side: flags, slices, steps, repeated heads, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boards as B
from ..functions import geometry as G
from ..operators import alignment as L
from ..operators import reader as R
from ..operators import series
from .sources import BLOCKS_SQL, BOARDS_SQL, blocks, boards, moves, table


def anchor_pages(spark, d):
    pages = table(spark, d, "embeddings").select((F.col("vec_id") % 200).alias("page"), (F.col("vec_id") % 3 > 0).alias("has_moves"))
    return R.pages_to_anchor(pages.groupBy("page").agg(F.bool_or("has_moves").alias("has_moves")), moves(spark, d))


def reader_flags(spark, d):
    fen = F.when(F.col("doc_id") % 5 > 0, F.concat_ws(" ", F.lit("8/8"), F.when(F.col("doc_id") % 2 == 0, "w").otherwise("b"), F.lit("- - 0 1")))
    rows = table(spark, d, "documents").select("doc_id", fen.alias("fen"), (F.col("doc_id") % 3 == 0).alias("side_known"), "text")
    return R.flags(rows).select("doc_id", "clickable", "white_to_move", "paragraph")


def text_slices(spark, d):
    """Whole texts cut at their spans and put together again, and what the first span holds."""
    span = lambda k, size: F.struct((F.length("text") % k).cast("int").alias("s"), (F.length("text") % k + size).cast("int").alias("e"))
    spans = F.array_sort(F.array(span(5, 4), span(11, 3), span(17, 6)))
    rows = table(spark, d, "conversations").select("conv_id", "turn", R.slices(F.col("text"), spans).alias("p"))
    moves = F.filter("p", lambda x: x["move"])
    return rows.select("conv_id", "turn", F.size(moves).alias("moves"), F.get(moves, F.lit(0))["part"].alias("first"), F.md5(F.array_join(F.transform("p", lambda x: x["part"]), "")).alias("text_md5"))


def page_steps(spark, d):
    return R.page_steps(table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("book"), F.col("l_suppkey").alias("page")))


def fit_zoom(spark, d):
    w, h = F.col("p_size") * 20.0, F.col("p_size") * 30.0
    return table(spark, d, "part").select("p_partkey", F.round(R.fit_zoom(w, h, F.lit(800.0), F.lit(600.0)), 6).alias("zoom"))


def next_main_move(spark, d):
    rows = moves(spark, d).withColumn("depth", F.when(F.col("ok"), 0).otherwise(1))
    return R.next_main_move(rows).select("page", "idx", "next_main")


def repeated_mentions(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("idx"), F.col("event_type").alias("value"))
    return R.said_before(rows, 3).select("idx", "repeated")


def ordered_distinct(spark, d):
    return R.first_seen(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


def dup_head_cut(spark, d):
    """Every third line runs on into the next one; lines after those were empty and have been read again."""
    after = F.lead("text").over(Window.partitionBy("page").orderBy("ord"))
    run_on = F.when(F.col("ord") % 3 == 0, F.concat_ws(" ", F.col("text"), after)).otherwise(F.col("text"))
    rows = blocks(spark, d).withColumn("text", run_on).withColumn("reread", F.col("ord") % 3 == 1)
    return R.heads_cut(rows).select("page", "ord", "cut", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def char_alignment(spark, d):
    """Neighbouring turns aligned character by character."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("b", before).where("b is not null").select("conv_id", "turn", F.col("text").alias("a"), "b")
    return L.aligned_share(rows).select("conv_id", "turn", "share", "placed")


#: A printed line has four pieces of ten characters, ten pixels wide each; lines are thirty pixels apart.
_LINE, _PIECE = 40, 10


def _printed(spark, d, damage: bool):
    """(blocks, pieces): turns as blocks, the words of which are spans, and their text as pieces of printed lines."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("ord"), F.col("text"))
    height = (F.floor(F.length("text") / _LINE) + 1) * 30
    top = F.col("ord") * 100_000
    spans = F.expr("transform(filter(sequence(0, greatest(length(text) - 1, 0)), i -> substr(text, i + 1, 1) <> ' ' and (i = 0 or substr(text, i, 1) = ' ')), i -> struct(i as s, case when locate(' ', text, i + 1) > 0 then locate(' ', text, i + 1) - 1 else length(text) end as e))")
    rows = turns.withColumn("text", F.regexp_replace("text", "\\s", " ")).withColumn("spans", spans)
    blocks = rows.select("page", "ord", "text", "spans", G.box(F.lit(0.0), top.cast("double"), F.lit(400.0), (top + height).cast("double")).alias("bbox"))
    pieces = rows.where("text <> ''").select("page", "ord", F.col("text"), F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(_PIECE))).alias("k", "at"))
    shown = F.substring("text", F.col("at") + 1, F.lit(_PIECE))
    if damage:  # some letters are misread, some pieces lost
        shown = F.when((F.col("page") + F.col("k")) % 3 == 0, F.translate(shown, "eaon", "cu0")).otherwise(shown)
        shown = F.when((F.col("page") * 7 + F.col("k")) % 11 == 0, "").otherwise(shown)
    row, x, wide = F.floor(F.col("at") / _LINE), F.col("at") % _LINE * 10.0, F.length(F.substring("text", F.col("at") + 1, F.lit(_PIECE))) * 10
    y = (F.col("ord") * 100_000 + row * 30).cast("double")
    placed = pieces.select("page", (F.col("ord") * 10_000 + row).alias("line"), F.col("k").alias("seq"), shown.alias("text"), G.box(x, y, x + wide, y + 20).alias("bbox"))
    return blocks, placed


def move_rects(spark, d):
    """Rectangles of the words of each turn, on the lines that they are printed on."""
    blocks, pieces = _printed(spark, d, damage=False)
    found = L.span_rects(blocks, L.block_streams(L.printed_lines(pieces), blocks))
    return found.select("page", "ord", "span", "s", "e", "share", F.array_join(F.transform("rects", lambda r: F.array_join(r.cast("array<string>"), " ")), "|").alias("rects"))


def damaged_rects(spark, d):
    """The same where letters are misread and pieces lost."""
    blocks, pieces = _printed(spark, d, damage=True)
    return L.span_rects(blocks, L.block_streams(L.printed_lines(pieces), blocks))


def figurine_picks(spark, d):
    cells = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("page"), F.col("source").alias("text"), "doc_id")
    picks = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page"), F.concat(F.lit("src"), (F.col("n_nationkey") % 20).cast("string")).alias("text"), F.substring("n_name", 1, 1).alias("letter"))
    return R.picked(cells, picks).select("doc_id", "letter")


def labelled_diagrams(spark, d):
    """Readings that match a game or have a label by hand, every second one printed with Black at the bottom."""
    rows = boards(spark, d).select("book", "id", F.when(F.col("id") % 4 == 0, "m1").alias("matches"), B.placement(F.col("read")).alias("fen"), (F.col("id") % 8 < 4).alias("flipped"))
    hand = boards(spark, d).where("id % 6 = 0").select("book", "id", F.concat(B.placement(F.col("cells")), F.lit(" w - - 0 1")).alias("fen"))
    return R.labelled(rows, hand).select("book", "id", B.squares(F.col("fen")).alias("cells"))


def median_by_parity(spark, d):
    """The median of a vector's values on light and on dark squares."""
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    key = F.concat_ws("_", "vec_id", ((F.floor(F.col("i") / 8) + F.col("i")) % 2).cast("string"))
    return series.median(cells.withColumn("key", key), "key", F.col("x").cast("double"))


QUERIES = {
    "anchor_pages": (anchor_pages, """WITH p AS (SELECT vec_id % 200 AS page, bool_or(vec_id % 3 > 0) AS h FROM embeddings GROUP BY 1), m AS (SELECT conv_id AS page, count(*) AS n, count_if(role <> 'assistant') AS bad FROM conversations GROUP BY 1)
        SELECT p.page FROM p LEFT JOIN m ON p.page = m.page WHERE h AND (coalesce(n, 0) = 0 OR bad > 0)"""),
    "reader_flags": (reader_flags, "SELECT doc_id, doc_id % 5 > 0 AS clickable, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 > 0 THEN doc_id % 2 = 0 END AS white_to_move, length(text) >= 150 AS paragraph FROM documents"),
    "text_slices": (text_slices, """WITH t AS (SELECT conv_id, turn, text, length(text) AS n, list_sort([[n % 5, n % 5 + 4], [n % 11, n % 11 + 3], [n % 17, n % 17 + 6]]) AS l FROM conversations),
        a AS (SELECT *, l[1][2] AS e1, CASE WHEN l[2][1] >= l[1][2] THEN 1 ELSE 0 END AS k2 FROM t), b AS (SELECT *, CASE WHEN l[3][1] >= CASE WHEN k2 = 1 THEN l[2][2] ELSE e1 END THEN 1 ELSE 0 END AS k3 FROM a)
        SELECT conv_id, turn, CAST(1 + k2 + k3 AS INTEGER) AS moves, substr(text, CAST(l[1][1] + 1 AS INTEGER), CAST(l[1][2] - l[1][1] AS INTEGER)) AS first, md5(text) AS text_md5 FROM b"""),
    "page_steps": (page_steps, """WITH p AS (SELECT DISTINCT l_orderkey % 40 AS book, l_suppkey AS page FROM lineitem)
        SELECT book, page, coalesce(lag(page) OVER w, page) AS previous, coalesce(lead(page) OVER w, page) AS next FROM p WINDOW w AS (PARTITION BY book ORDER BY page)"""),
    "fit_zoom": (fit_zoom, "SELECT p_partkey, round(greatest(10.0::DOUBLE, least(400.0::DOUBLE, least(800.0::DOUBLE / (p_size * 20.0::DOUBLE), 600.0::DOUBLE / (p_size * 30.0::DOUBLE)) * 100)), 6) AS zoom FROM part"),
    "next_main_move": (next_main_move, "SELECT conv_id AS page, turn AS idx, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_main FROM conversations"),
    "repeated_mentions": (repeated_mentions, """SELECT event_id AS idx, coalesce(list_contains(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), event_type), false) AS repeated FROM events"""),
    "ordered_distinct": (ordered_distinct, "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source"),
    "dup_head_cut": (dup_head_cut, f"""WITH {BLOCKS_SQL}, r AS (SELECT page, ord, ord % 3 = 1 AS again, CASE WHEN ord % 3 = 0 THEN concat_ws(' ', text, lead(text) OVER (PARTITION BY page ORDER BY ord)) ELSE text END AS t FROM blocks),
        h AS (SELECT a.page, a.ord, any_value(a.t) AS t, coalesce(list(substr(b.t, 1, 25) ORDER BY b.ord) FILTER (WHERE b.ord IS NOT NULL), []) AS heads
              FROM r a LEFT JOIN r b ON a.page = b.page AND b.again AND b.t <> '' AND a.ord <> b.ord AND (NOT a.again OR b.ord > a.ord) GROUP BY a.page, a.ord),
        c AS (SELECT page, ord, t, list_reduce([t] || heads, lambda acc, x: CASE WHEN strpos(acc, x) > 1 THEN regexp_replace(left(acc, CAST(strpos(acc, x) - 1 AS INTEGER)), '\\s+$', '') ELSE acc END) AS kept FROM h)
        SELECT page, ord, length(kept) < length(t) AS cut, CAST(length(kept) AS INTEGER) AS n, md5(kept) AS text_md5 FROM c"""),
    "char_alignment": (char_alignment, None),
    "move_rects": (move_rects, r"""WITH t AS (SELECT conv_id AS page, turn AS ord, regexp_replace(text, '\s', ' ', 'g') AS text FROM conversations), c AS (SELECT page, ord, unnest(range(length(text))) AS i, text FROM t),
        l AS (SELECT page, ord, i, sum(CASE WHEN i = 0 OR text[i] = ' ' THEN 1 ELSE 0 END) FILTER (WHERE text[i + 1] <> ' ') OVER (PARTITION BY page, ord ORDER BY i) - 1 AS span FROM c WHERE text[i + 1] <> ' '),
        r AS (SELECT page, ord, span, i // 40 AS row, min(i) AS a, max(i) + 1 AS b, CAST(min(i) % 40 * 10 - 2 AS VARCHAR) || ' ' || (ord * 100000 + i // 40 * 30 - 2) || ' ' || (count(*) * 10 + 4) || ' 24' AS rect FROM l GROUP BY page, ord, span, i // 40)
        SELECT page, ord, CAST(span AS INTEGER) AS span, CAST(min(a) AS INTEGER) AS s, CAST(max(b) AS INTEGER) AS e, 1.0::DOUBLE AS share, string_agg(rect, '|' ORDER BY row) AS rects FROM r GROUP BY page, ord, span"""),
    "damaged_rects": (damaged_rects, None),
    "figurine_picks": (figurine_picks, "SELECT doc_id, n_name[1:1] AS letter FROM documents JOIN nation ON doc_id % 50 = n_nationkey AND source = 'src' || (n_nationkey % 20)"),
    "labelled_diagrams": (labelled_diagrams, f"WITH {BOARDS_SQL}, u AS (SELECT book, id, CASE WHEN id % 6 = 0 THEN cells ELSE read END AS c FROM boards WHERE id % 4 = 0 OR id % 6 = 0) SELECT book, id, CASE WHEN id % 8 < 4 THEN reverse(c) ELSE c END AS cells FROM u"),
    "median_by_parity": (median_by_parity, """WITH c AS (SELECT vec_id, unnest(range(64)) AS i, embedding AS e FROM embeddings), k AS (SELECT vec_id || '_' || ((i // 8 + i) % 2) AS key, CAST(e[i + 1] AS DOUBLE) AS x FROM c)
        SELECT key, count(*) AS n, median(x) AS median FROM k GROUP BY key"""),
}
