"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, lines, mixing, ngram_join, periodic, preference, quality, topk, toxicity, urlfilter, variants
from .common import WORD, table

Query = Callable[[SparkSession, str], DataFrame]

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Judged where no rule fits: globs of pages that are no prose.  The SQL is made from them.
URL_GLOBS = ("*/login**", "*/**/login**", "*/cart**", "*/**/cart**", "*/**.exe", "*/**.zip")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, key, kept) of every document."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op2_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urlfilter.Rule.prefix(*r) for r in URL_RULES]
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules, "allow", [urlfilter.Rule(g, "block") for g in URL_GLOBS])


OP2_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_full_match('.' || host || path, '{"|".join(urlfilter.as_regex(g) for g in URL_GLOBS)}') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m USING (page_id)
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_join.join(table(spark, sf_dir, "documents"), n=3, percent=90)
    return members.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen and rejected: the conversations 2k and 2k + 1.  Masks are written as `begin-end` joined by commas."""
    turns = table(spark, sf_dir, "conversations")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    pairs = preference.format_pairs(turns, preference.neighbour_pairs(turns))
    return pairs.withColumns({"chosen_mask": spans(F.col("chosen_mask")), "rejected_mask": spans(F.col("rejected_mask"))})


OP4_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t),
c AS (SELECT conv_id // 2 AS pair_id, * FROM n WHERE conv_id % 2 = 0), r AS (SELECT conv_id // 2 AS pair_id, * FROM n WHERE conv_id % 2 = 1),
b AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, coalesce(c.role = r.role AND c.text = r.text, false) AS same,
             c.shown AS cs, r.shown AS rs, c.role AS cr, r.role AS rr FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.k = r.k),
p AS (SELECT *, min(CASE WHEN NOT same THEN k END) OVER (PARTITION BY pair_id) AS cut FROM b),
q AS (SELECT *, sum(length(cs)) OVER (PARTITION BY pair_id, (cut IS NULL OR k < cut) ORDER BY k) AS ce, sum(length(rs)) OVER (PARTITION BY pair_id, (cut IS NULL OR k < cut) ORDER BY k) AS re FROM p)
SELECT pair_id, CAST(count(*) FILTER (WHERE cut IS NULL OR k < cut) AS INTEGER) AS n_prompt,
       coalesce(string_agg(cs, '' ORDER BY k) FILTER (WHERE cut IS NULL OR k < cut), '') AS prompt,
       coalesce(string_agg(cs, '' ORDER BY k) FILTER (WHERE k >= cut), '') AS chosen,
       coalesce(string_agg(rs, '' ORDER BY k) FILTER (WHERE k >= cut), '') AS rejected,
       coalesce(string_agg(CAST(ce - length(cs) + 13 + length(cr) AS BIGINT) || '-' || CAST(ce AS BIGINT), ',' ORDER BY k) FILTER (WHERE k >= cut AND cr = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(re - length(rs) + 13 + length(rr) AS BIGINT) || '-' || CAST(re AS BIGINT), ',' ORDER BY k) FILTER (WHERE k >= cut AND rr = 'assistant'), '') AS rejected_mask
FROM q GROUP BY pair_id
"""


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


OP5_SQL = r"""
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN, decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; position is that of its first copy, to thousandths, null if it is not taken."""
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    first = F.round(F.get("copies", F.lit(0))["position"], 3)
    rows = planned.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS k, coalesce(md5(CAST(doc_id AS VARCHAR)), repeat('0', 32)) AS o FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY k) - 1) % 3] AS weight FROM s),
x AS (SELECT *, 3 * source_size / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
l AS (SELECT *, (total - coalesce(CAST(sum(3 * source_size) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
             / CAST(sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM x),
f AS (SELECT arg_min(level, (ratio, k)) AS fill FROM l WHERE level <= ratio),
t AS (SELECT k, source_size, weight, total, least(CAST(3 * source_size AS DOUBLE), fill * weight) AS target FROM x, f),
p AS (SELECT d.*, source_size, weight, total, target, coalesce(CAST(sum(size) OVER (PARTITION BY d.k ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
      FROM d JOIN t ON d.k = t.k),
c AS (SELECT *, greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - start)) AS t0,
             greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - source_size - start)) + greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - 2 * source_size - start)) AS more FROM p)
SELECT doc_id, size, source_size, target, CAST(t0 + more AS BIGINT) AS taken,
       round(CASE WHEN t0 <= 0 THEN NULL WHEN start = 0 THEN 0.0
            WHEN weight = 5 THEN total * least(2 * (start / target) / (1.25 + sqrt(1.5625 - start / target)), 1.0)
            WHEN weight = 2 THEN total * (start / target)
            WHEN start / target < 0.375 THEN total * least(2 * (start / target) / (0.5 + sqrt(0.25 + 2 * (start / target))), 0.5)
            ELSE total * least(0.5 + 2 * (start / target - 0.375) / (1.0 + sqrt(1.0 + 2 * (start / target - 0.375))), 1.0) END, 3) AS position
FROM c
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text_sha256 of what is left) of every document."""
    rows = lines.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"), misspell=199)


def _looped(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text): where ten divides the CRC-32 of the id, the words from some place on repeat with some period."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = ((h - h % 10) / 10).cast("long")

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    looped = F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return docs.select("doc_id", F.when(F.coalesce(h % 10 == 0, F.lit(False)), looped).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of each document is that of the largest length by period, compared as exact products."""
    found = periodic.find(_looped(table(spark, sf_dir, "documents")))
    better = lambda r, b: (r["length"] * b["period"] > b["length"] * r["period"]) | b["period"].isNull()
    first = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(better(r, b), r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", first)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP13_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS shown
      FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM v),
o AS (SELECT k, size, p, array_to_string(w[p : p + size - 1], ' ') AS shown FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM w, s WHERE len(w) >= size)),
h AS (SELECT k, p, v.size, item FROM o JOIN v USING (size, shown)),
n AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(p, p + size)) AS place FROM h) GROUP BY k),
l AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN n USING (k) LEFT JOIN l USING (k)
"""


def queries() -> dict[str, Query]:
    listed = (
        op1_importance_resampling, op2_url_globs, op3_ngram_jaccard, op4_preference_pairs, op5_exact_top_k,
        op6_toxicity, op7_byte_bpe, op8_ivf_pq, op9_curriculum_mix, op10_line_dedup, op11_spelling_variants, op12_periodic_runs, op13_decontamination,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_globs": OP2_SQL, "op4_preference_pairs": OP4_SQL, "op5_exact_top_k": OP5_SQL, "op9_curriculum_mix": OP9_SQL, "op13_decontamination": OP13_SQL}
