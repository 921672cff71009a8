"""From raw documents to token ids: quality, line dedup, near duplicates, mixing, byte BPE.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm import bpe, lines, mixing, ngram_join, quality
from plyframe.llm.common import durable, table, unnamed
from plyframe.llm.queries import PATTERN, RANKS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws; the others go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one; documents of which no line is left go."""
    return lines.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group with a similarity of 0.8 or more on five words."""
    return ngram_join.distinct_documents(docs, n=5, percent=80, repeats=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, once for each copy of which the mix takes half of the words or more.

    A document without words is never taken, so it leaves here.
    """
    plain, names = unnamed(docs)
    planned = mixing.plan(plain, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"])
    copies = mixing.curriculum(planned, names["doc_id"]).where(2 * F.col("words") >= F.col("size"))
    return copies.select(*plain.columns).toDF(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each whole text."""
    rows = bpe.encode(docs, RANKS, PATTERN, decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", "n_tokens", "ids", digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("byte_bpe", bpe_stage)]

#: No SQL expresses the classifier, the edit join and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is cut from its lineage by a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
