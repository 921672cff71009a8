"""The driver's tables read as tables of books: what stands for blocks, boxes, boards and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SQUARE_CLASSES
from ..functions import boards as B
from ..functions import geometry as G

#: Orders of a page where the number of pages grows with the tables.
LINES_OF_PAGE = 120

#: Pages that all orders are dealt to where the pages themselves grow with the tables.
DEALT_PAGES = 500

LABELS = ("text", "paragraph_title", "header", "footer", "image", "chart")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks (page, ord, label, text, bbox)."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), ((F.col("page") + F.col("ord")) % len(LABELS)).cast("int"))
    y0 = F.col("ord") * 400
    return lines.select("page", "ord", label.alias("label"), "text", G.box(F.lit(0), y0, 600 + (F.length("text") % 7) * 100, y0 + 300).alias("bbox"))


BLOCKS_SQL = f"""lines AS (SELECT doc_id AS page, string_split(text, chr(10)) AS l FROM documents),
placed AS (SELECT page, l, unnest(range(len(l))) AS i FROM lines),
blocks AS (SELECT page, CAST(i AS INTEGER) AS ord, {list(LABELS)}[1 + (page + i) % {len(LABELS)}] AS label, l[i + 1] AS text,
                  0 AS x0, i * 400 AS y0, 600 + (length(l[i + 1]) % 7) * 100 AS x1, i * 400 + 300 AS y1 FROM placed)"""


def _page(key: Column, dealt: bool) -> Column:
    return key % DEALT_PAGES if dealt else (key / LINES_OF_PAGE).cast("long")


def points(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Lines of orders as printed lines with a centre (page, line, cx, cy); `dealt`: on a fixed number of pages."""
    return table(spark, sf_dir, "lineitem").select(
        _page(F.col("l_orderkey"), dealt).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        (F.col("l_partkey") % 600).cast("double").alias("cx"), ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 211) % 3000).cast("double").alias("cy"),
    )


def boxes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Orders as boxes (page, box, bbox); `dealt`: on a fixed number of pages."""
    x0, y0 = (F.col("o_custkey") % 500).cast("double"), ((F.col("o_orderkey") * 31) % 2800).cast("double")
    return table(spark, sf_dir, "orders").select(_page(F.col("o_orderkey"), dealt).alias("page"), F.col("o_orderkey").alias("box"), G.box(x0, y0, x0 + 100, y0 + 150).alias("bbox"))


def _places_sql(page: str) -> str:
    return f"""points AS (SELECT l_orderkey {page} AS page, l_orderkey * 10 + l_linenumber AS line, CAST(l_partkey % 600 AS DOUBLE) AS cx, CAST((l_suppkey * 37 + l_linenumber * 211) % 3000 AS DOUBLE) AS cy FROM lineitem),
boxes AS (SELECT o_orderkey {page} AS page, o_orderkey AS box, CAST(o_custkey % 500 AS DOUBLE) AS x0, CAST((o_orderkey * 31) % 2800 AS DOUBLE) AS y0, x0 + 100 AS x1, y0 + 150 AS y1 FROM orders)"""


PLACES_SQL, DEALT_SQL = _places_sql(f"// {LINES_OF_PAGE}"), _places_sql(f"% {DEALT_PAGES}")


def classes(embedding: Column) -> Column:
    """Classes 0-12 of 64 numbers."""
    return F.transform(embedding, lambda x: (F.floor(F.abs(x.cast("double")) * 100) % 13).cast("int"))


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as boards (id, book, cells); `read` is a reading of the board with id % 7 squares misread as empty."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("book"), B.from_classes(classes(F.col("embedding"))).alias("cells"))
    wrong = (F.col("id") % 7).cast("int")
    return rows.withColumn("read", F.concat(F.repeat(F.lit("."), wrong), F.substring(F.col("cells"), wrong + 1, F.lit(64))))


BOARDS_SQL = f"""boards AS (SELECT vec_id AS id, label AS book, array_to_string(list_transform(embedding, lambda x: substr('{SQUARE_CLASSES}', 1 + CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS INTEGER) % 13, 1)), '') AS cells,
            repeat('.', CAST(vec_id % 7 AS INTEGER)) || substr(cells, CAST(vec_id % 7 AS INTEGER) + 1, 64) AS read FROM embeddings)"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as moves (page, idx, ok, text): assistant turns are legal."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("idx"), (F.col("role") == "assistant").alias("ok"), "text")


def _pick(letters: str, i: Column) -> Column:
    """The letter of a number, `-` for none."""
    return F.translate(F.substring(F.lit(letters), (i % len(letters) + 1).cast("int"), F.lit(1)), "-", "")


def printed_move(i: Column, pieces: str) -> Column:
    """A move made from a number: piece, square, sign."""
    mark = F.get(F.array(*[F.lit(m) for m in ("", "+", "!", "?!")]), (i % 4).cast("int"))
    return F.concat(_pick("-" + pieces, i), _pick("abcdefgh", i * 5), (i * 3 % 8 + 1).cast("string"), mark)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages (page, text) of one printed line each, with a variation, a remark and a result."""
    key, step = F.col("p_partkey"), F.col("p_size") + 1
    m = [printed_move(key + j * step, "NBRQK") for j in range(8)]
    n = [(1 + k + key % 40).cast("string") for k in range(3)]
    text = F.concat(n[0], F.lit(". "), m[0], F.lit(" "), m[1], F.lit(" "), n[1], F.lit(". "), m[2], F.lit(" ("), n[1], F.lit(". "), m[3], F.lit(" "), m[4], F.lit(") "), n[1], F.lit("... "), m[5],
                    F.lit(" A good move; "), n[2], F.lit(". "), m[6], F.lit(" "), m[7], F.lit(" 1-0"))
    return table(spark, sf_dir, "part").select(key.alias("page"), text.alias("text"))


def _move_sql(i: str, pieces: str) -> str:
    return f"(replace(substr('-{pieces}', CAST(1 + ({i}) % {len(pieces) + 1} AS INTEGER), 1), '-', '') || substr('abcdefgh', CAST(1 + ({i}) * 5 % 8 AS INTEGER), 1) || (1 + ({i}) * 3 % 8) || ['', '+', '!', '?!'][1 + ({i}) % 4])"


GAMES_SQL = "games AS (SELECT p_partkey AS page, 1 + p_partkey % 40 AS n, [" + ", ".join(_move_sql(f"p_partkey + {j} * (p_size + 1)", "NBRQK") for j in range(8)) + "] AS m FROM part)"


def sparse_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards (id, cells) with about every fifth square of the vectors' boards, and kings of their own, which some lack."""
    def cell(i: Column) -> Column:
        own = F.substring(F.translate("cells", "Kk", ".."), i + 1, F.lit(1))
        kings = F.when(i == 60, F.when(F.col("id") % 4 != 1, "K").otherwise(".")).when(i == 4, F.when(F.col("id") % 4 != 2, "k").otherwise("."))
        return F.coalesce(kings, F.when((i * 7 + F.col("id")) % 5 == 0, own).otherwise("."))

    return boards(spark, sf_dir).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), cell), "").alias("cells"))


SPARSE_SQL = BOARDS_SQL.replace("boards AS", "full_boards AS") + """, boards AS (SELECT id, array_to_string(list_transform(range(64), lambda i: CASE WHEN i = 60 THEN CASE WHEN id % 4 <> 1 THEN 'K' ELSE '.' END WHEN i = 4 THEN CASE WHEN id % 4 <> 2 THEN 'k' ELSE '.' END
            WHEN (i * 7 + id) % 5 = 0 THEN substr(translate(cells, 'Kk', '..'), CAST(i + 1 AS INTEGER), 1) ELSE '.' END), '') AS cells FROM full_boards)"""
