"""Queries through book archives: documents and vectors are written as books, and read again by the data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archive, bookzip, shared
from .sources import BLOCKS_SQL, BOARDS_SQL, blocks, boards, table

PAGES_OF_BOOK = 50


def _book(page: str):
    return F.concat(F.lit("b"), F.format_string("%06d", F.floor(F.col(page) / PAGES_OF_BOOK)))


def _written(spark: SparkSession, d: str, name: str) -> str:
    """Books of 50 pages: documents as text pages, their turns as moves, vectors as diagrams, and each page's text as its scan."""
    docs = table(spark, d, "documents")
    sizes = docs.select(_book("doc_id").alias("book"), F.col("doc_id").cast("int").alias("page"), F.lit(1200).alias("width"), (F.col("n_chars") % 900 + 1000).cast("int").alias("height"))
    page = F.col("page").cast("int").alias("page")
    corners = F.array(*[F.col(f"bbox.{k}").cast("int") for k in ("x0", "y0", "x1", "y1")])
    texts = blocks(spark, d).select(_book("page").alias("book"), page, "ord", F.concat_ws("_t", F.concat(F.lit("p"), F.col("page")), "ord").alias("id"), corners.alias("bbox"), "text")
    turns = table(spark, d, "conversations").select(
        _book("conv_id").alias("book"), F.col("conv_id").cast("int").alias("page"), F.col("turn").alias("ord"), F.concat_ws("_m", F.concat(F.lit("p"), F.col("conv_id")), "turn").alias("id"),
        F.md5("text").alias("fen"), (F.col("role") == "assistant").alias("ok"),
    )
    shown = boards(spark, d).select(
        _book("id").alias("book"), F.col("id").cast("int").alias("page"), F.lit(0).alias("ord"), F.concat(F.lit("p"), F.col("id"), F.lit("_d1")).alias("id"), F.col("read").alias("fen"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id"), F.lit("_m"), F.col("id") % 5)).alias("matches_move"),
    )
    documents = archive.page_documents(texts, turns, sizes, shown)
    scans = docs.select(_book("doc_id").alias("book"), F.format_string("scans/p%04d.png", F.col("doc_id")).alias("name"), F.encode("text", "UTF-8").alias("bytes"))
    manifest = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.concat(F.lit("Book "), F.col("book")).alias("title"), F.col("n").cast("int").alias("page_count")))
    manifests = sizes.groupBy("book").agg(F.count(F.lit(1)).alias("n")).select("book", F.lit("manifest.json").alias("name"), F.encode(manifest, "UTF-8").alias("bytes"))
    folder = shared.folder(spark, f"books/{name}")
    bookzip.write(documents.unionByName(scans).unionByName(manifests), folder)
    return folder


def _corrections(rows: DataFrame) -> DataFrame:
    """(book, name, bytes) of corrections documents from rows (book, target, type, value, source_hash)."""
    listed = F.array_sort(F.collect_list(F.struct("target", "type", "value", "source_hash")))
    made = rows.groupBy("book").agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), listed.alias("corrections"))).alias("text"))
    return made.select("book", F.lit("corrections.json").alias("name"), F.encode("text", "UTF-8").alias("bytes"))


def archive_pages(spark, d):
    """Pages read from the archives; nothing of the scans is decompressed."""
    pages = archive.pages(archive.members(spark, _written(spark, d, "pages")))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return pages.select("book", "page", "height", F.size("blocks").alias("blocks"), F.size("moves").alias("moves"), F.md5(text).alias("text_md5"))


def archive_members(spark, d):
    """Names and sizes of the scans of every second book, by a list of the books."""
    folder = _written(spark, d, "members")
    rows = bookzip.read(spark, folder, content="false").where(F.col("name").startswith("scans/") & F.col("book").endswith("1"))
    return rows.select("book", "name", "size")


def archive_lookup(spark, d):
    """Scans that orders ask for, many of them of one book, some that are not there."""
    folder = _written(spark, d, "lookup")
    page = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % PAGES_OF_BOOK).otherwise(F.col("o_orderkey") % 700)
    keys = table(spark, d, "orders").select(page.alias("page")).distinct().select(_book("page").alias("book"), F.format_string("scans/p%04d.png", F.col("page")).alias("name"))
    return bookzip.lookup(keys, folder).select("book", "name", F.md5("bytes").alias("bytes_md5"))


def archive_matches(spark, d):
    return archive.matched_diagrams(archive.pages(archive.members(spark, _written(spark, d, "matches")))).select("book", "id", F.md5("fen").alias("fen_md5"), "full")


def archive_corrections(spark, d):
    """Corrections saved to the archives, twice for every second diagram, survive a new run that writes the books again."""
    folder = _written(spark, d, "corrections")
    rows = boards(spark, d).select(
        _book("id").alias("book"), F.concat(F.lit("p"), F.col("id"), F.lit("_d1")).alias("target"), F.lit("diagram_fen").alias("type"), F.col("cells").alias("value"), F.sha2("read", 256).alias("source_hash"), "id"
    )
    bookzip.write(_corrections(rows.where("id % 4 < 2").drop("id")), folder, update=True)
    old = archive.corrections(archive.members(spark, folder))
    new = rows.where("id % 2 = 0").drop("id").withColumn("value", F.reverse("value"))
    both = old.withColumn("at", F.lit(0)).unionByName(new.withColumn("at", F.lit(1)))
    last = both.groupBy("book", "target").agg(*[F.max_by(c, "at").alias(c) for c in ("type", "value", "source_hash")])
    saved = shared.folder(spark, "books/saved")
    last.write.mode("overwrite").parquet(saved)  # the archives it reads are written next
    bookzip.write(_corrections(spark.read.parquet(saved)), folder, update=True)
    _written(spark, d, "corrections")
    return archive.corrections(archive.members(spark, folder)).select("book", "target", F.md5("value").alias("value_md5"), "source_hash")


_BOOK = f"'b' || lpad(CAST({{}} // {PAGES_OF_BOOK} AS VARCHAR), 6, '0')"

QUERIES = {
    "archive_pages": (archive_pages, f"""WITH {BLOCKS_SQL}, b AS (SELECT page, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY ord)) AS m FROM blocks GROUP BY page), t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
        SELECT {_BOOK.format('doc_id')} AS book, CAST(doc_id AS INTEGER) AS page, CAST(n_chars % 900 + 1000 AS INTEGER) AS height, CAST(b.n AS INTEGER) AS blocks, CAST(coalesce(t.n, 0) AS INTEGER) AS moves, m AS text_md5
        FROM documents JOIN b ON doc_id = b.page LEFT JOIN t ON doc_id = conv_id"""),
    "archive_members": (archive_members, f"SELECT {_BOOK.format('doc_id')} AS book, printf('scans/p%04d.png', doc_id) AS name, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE {_BOOK.format('doc_id')} LIKE '%1'"),
    "archive_lookup": (archive_lookup, f"""WITH k AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % {PAGES_OF_BOOK} ELSE o_orderkey % 700 END AS page FROM orders)
        SELECT {_BOOK.format('page')} AS book, printf('scans/p%04d.png', page) AS name, md5(text) AS bytes_md5 FROM k LEFT JOIN documents ON page = doc_id"""),
    "archive_matches": (archive_matches, f"""WITH {BOARDS_SQL} SELECT {_BOOK.format('id')} AS book, 'p' || id || '_d1' AS id, md5(read) AS fen_md5, md5(conversations.text) AS "full"
        FROM boards JOIN conversations ON conv_id = id AND turn = id % 5 JOIN documents ON doc_id = id WHERE id % 3 > 0 AND role = 'assistant'"""),
    "archive_corrections": (archive_corrections, f"WITH {BOARDS_SQL} SELECT {_BOOK.format('id')} AS book, 'p' || id || '_d1' AS target, md5(CASE WHEN id % 2 = 0 THEN reverse(cells) ELSE cells END) AS value_md5, sha256(read) AS source_hash FROM boards WHERE id % 4 < 2 OR id % 2 = 0"),
}
