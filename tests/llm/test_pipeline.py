"""The stages of the pipeline against plain computations, each on its predecessor's rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plyframe.llm import bpe, lines, mixing, quality, queries
from plyframe.llm.common import durable

from .test_documents import component_ids


@pytest.fixture(scope="module")
def steps(spark, tables):
    """[documents, what each stage returned]."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], tables)))
    return out


def test_stages_keep_clashing_columns(spark, tables):
    """Columns named like those that the operators make pass through; null and empty texts pass every stage."""
    made = ("key", "ratio", "n_lines", "n_dropped", "size", "weight", "total", "words", "position", "node", "_gone_id", "range")
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in made})
    docs = docs.unionByName(docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.when(F.col("doc_id") == 0, "").cast("string")}))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, tables))
        assert docs.columns == before.columns and docs.count() > 0
        assert docs.where(" or ".join(f"{c} <> concat('{c}', cast(doc_id % 100000 as string))" for c in made)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == docs.count()


def test_stages_of_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, tables))
        assert docs.columns == before.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == 0


def test_stages_of_documents_without_words(spark, tables):
    """Null, empty and blank texts only: every stage ends, and none is left after quality."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(3).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" \n")))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert durable(stage(spark, docs, tables)).columns == docs.columns
    assert corpus_pipeline.STAGES[0][1](spark, docs, tables).count() == 0


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1]) and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "byte_bpe"]


def test_quality_keeps_what_is_drawn_and_all_clean_documents(spark, tables, steps):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    drawn = {r.doc_id for r in quality.resample(steps[0], labels)[0].where("kept").collect()}
    got, clean = rows(steps[1]), {r.doc_id for r in labels.where("quality = 1").collect()}
    assert set(got) == drawn and len(clean - drawn) <= 0.01 * len(clean)
    assert all(rows(steps[0])[i].text == r.text for i, r in got.items())


def test_lines(steps):
    seen, want = {}, {}
    for doc, r in sorted(rows(steps[1]).items()):
        kept, parts = [], (r.text or "").split("\n")
        for line in parts:
            near = [o for n in range(len(line) - 2, len(line) + 3) for o in seen.get(n, ())]
            if len(line) < 24 or not near or not lines.within(near, [line] * len(near), 2).any():
                kept.append(line)
            if len(line) >= 24:
                seen.setdefault(len(line), []).append(line)
        if kept or len(parts) == len(kept):
            want[doc] = "\n".join(kept)
    got = rows(steps[2])
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for d, r in got.items() if r.text != rows(steps[1])[d].text)


def test_near_duplicates(steps):
    before = [(d, r.text) for d, r in sorted(rows(steps[2]).items())]
    assert set(rows(steps[3])) == {d for d, _, c in component_ids(before, 5, 80) if d == c} | {d for d, t in before if not t.split()}


def test_mixing(steps):
    taken = {r.doc_id: [c.words for c in r.copies] + [r.size] for r in mixing.plan(steps[3]).collect()}
    want = Counter({d: sum(2 * w >= x[-1] for w in x[:-1]) for d, x in taken.items()})
    assert Counter(r.doc_id for r in steps[4].collect()) == +want


def test_tokens_and_run(spark, tables, steps):
    enc = bpe.encoding(queries.RANKS, queries.PATTERN)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    last = steps[5].collect()
    assert all(list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in last)
    again = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in again) == Counter((r.doc_id, r.ids_sha256) for r in last)
