"""Operators over urls, conversations and vectors."""

import fnmatch
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.llm import ann, preference, queries, topk, urlfilter
from plyframe.llm import vectors as vectors_module
from plyframe.llm.components import components
from tests.against import connect, rows_of, rows_of_sql

# --- 2: URL filters


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
            continue
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return out


GLOBS = ["*.example.com/en/**", "**.zip", "*a?c*", "", "**", "*", "é*", "?", "long" * 40 + "**", "*/**/x", "***b", r"a\*\?\\", "x\\"]
URLS = ["", ".www.example.com/en/1", ".example.com/en", "abc", "a/c", "éa", "é", "x.zip", "long" * 40 + "z", ".h/a/b/x", ".h/x", "ab", "/", "aaabccc", None, "y" * 5000 + "b", r"a*?" + "\\", "abcd", "x\\"]


def test_automaton_equals_regular_expressions():
    got = urlfilter.Automaton(GLOBS).matches(URLS)
    want = [[re.fullmatch(as_regex(g), u or "") is not None for g in GLOBS] for u in URLS]
    assert got.tolist() == want
    assert [[re.fullmatch(urlfilter.as_regex(g), u or "") is not None for g in GLOBS] for u in URLS] == want
    assert fnmatch.fnmatch("x.zip", "*.zip")


def test_rules_over_odd_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://badexample.com/en/", "https://a.net/es/1", "http://net/fr/", "http://x.com", "http://x.org/login", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, html string, rule string")
    rules = [urlfilter.Rule.prefix(*r) for r in queries.URL_RULES]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules, "allow", [urlfilter.Rule("*/login", "block")]).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == got[11] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5][2:] == ("com/", "allow") and got[6][2:] == ("net/es/", "block") and got[7][2:] == ("net/fr/", "block")
    assert got[8] == ("x.com", "", None, "allow") and got[9][2:] == (None, "block") and got[10][:2] == ("b:", "//c/d")
    assert urlfilter.judge(pages.limit(0), rules, "allow").count() == 0


def test_production_globs_at_the_top_of_a_site(spark):
    urls = {"https://x.org/login": "block", "https://x.org/login/a": "block", "https://x.org/cart?a=b": "block", "https://x.org/a/b/cart": "block", "https://x.org/a/login": "block", "https://login.org/": "allow", "https://x.org/alogin": "allow"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = [urlfilter.Rule.prefix(*r) for r in queries.URL_RULES]
    got = urlfilter.judge(pages, rules, "allow", [urlfilter.Rule(g, "block") for g in queries.URL_GLOBS]).collect()
    assert {r.page_id: r.verdict for r in got} == dict(enumerate(urls.values()))


def test_production_globs_equal_their_sql(spark, tmp_path):
    urls = ["http://x.org/login", "http://x.org/cart", "http://foo.zip", "http://a.exe", "http://foo.zip/", "http://x.org/a.zip", "http://x.org/.exe", "http://x.org/a/b/c.zip?x", "http://x.org", "a.zip", "://", "http:///login",
            "http://y.com/x.zip", "http://a.net/es/x.exe", "http://x.org/a\nb/login", None, "http://X.ORG/LOGIN", "http://x.org/a.zip/b", "http://login/login", "http://x.org//login", "http://é.org/é/cart"]
    spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows_of(queries.op2_url_globs(spark, str(tmp_path))) == rows_of_sql(con, queries.OP2_SQL)


def test_prefix_rules_are_literal(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a*b/c"), (2, "http://x.org/aab/c"), (3, "http://y.x.org/a*b/")], "page_id long, url string")
    got = urlfilter.judge(pages, [urlfilter.Rule.prefix("x.org", "/a*b/", "block")], "allow").collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("x.org/a*b/", "block"), 2: (None, "allow"), 3: ("x.org/a*b/", "block")}


# --- 4: preference formatting


def test_common_prefix_is_rendered_once(spark):
    said = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", None),
            (2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "x"), (7, None, "user", "x")]
    turns = spark.createDataFrame([(*s, "clash") for s in said], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in preference.format_pairs(turns, preference.neighbour_pairs(turns)).collect()}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[0].prompt == show("user", "hi") and got[0].n_prompt == 1
    assert got[0].chosen == show("assistant", "yes") and got[0].rejected == show("assistant", "no") + show("user", "")
    begin, end = got[0].chosen_mask[0]
    assert got[0].chosen[begin:end] == "yes<|im_end|>\n" and len(got[0].rejected_mask) == 1
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == ("", show("user", "alone"), "")
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (show("user", "same"), "", "", [])
    assert (got[3].n_prompt, got[3].prompt, got[3].chosen) == (0, "", "")
    assert preference.format_pairs(turns.limit(0), preference.neighbour_pairs(turns.limit(0))).count() == 0


# --- 5: exact top-k, 8: approximate neighbours


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], 0, "clash") for i, row in enumerate(x)] + [(*e, 0, "clash") for e in extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


ODD = [(1000, None), (1001, [None] + [1.0] * 15), (1002, [float("nan")] + [1.0] * 15), (1003, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (1005, [])]
SHORT = [(1020, [1.0, 2.0]), (1040, [2.0, -1.0]), (1004, [-1.0, 0.5]), (1050, [3.0])]  # meet only each other


def brute(x, queries_, k, score):
    out = []
    for q in queries_:
        ranked = sorted(((-score(x[q], x[c]), c) for c in range(len(x)) if c != q))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("levels", [(4, 16), (1,), ()])
def test_top_k_equals_brute_force(spark, levels, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 16)).astype(np.float32).round(1)
    x[50:60] = x[7]  # ties
    monkeypatch.setattr(topk, "TILE", 17)
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(vectors_module, "PACKED", 16)
    monkeypatch.setattr(vectors_module, "BUCKET", 40)
    df = vectors(spark, x, [*ODD, *SHORT, (119, x[119].tolist())])
    whole = np.floor(64 * x.astype(np.float64)).astype(int)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 20, levels=levels, floor_rows=30)
    short = [(q, 1 + i % 2, v, int(s)) for i, (q, _, v, s) in enumerate(sorted([(1020, 0, 1040, 0), (1020, 0, 1004, 0), (1040, 0, 1020, 0), (1040, 0, 1004, -10240)], key=lambda p: (p[0], -p[3], p[2])))]
    assert sorted(map(tuple, got.collect())) == sorted(brute(whole, range(0, 120, 20), 20, lambda a, b: int(a @ b)) + short)


def test_repeated_rows_leave_room_for_others(spark):
    """A row repeated more than k times among the best of one tile."""
    x = np.random.default_rng(5).normal(size=(120, 16)).astype(np.float32).round(1)
    x[3] = 4 * x[0]
    df = vectors(spark, x, [(3, x[3].tolist())] * 50 + [(0, x[0].tolist())] * 3)
    whole = np.floor(64 * x.astype(np.float64)).astype(int)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 20)
    assert sorted(map(tuple, got.collect())) == brute(whole, range(0, 120, 20), 20, lambda a, b: int(a @ b))
    best = vectors_module.Best(1, 2)
    best.add(np.array([[9.0, 9.0, 9.0, 5.0, 4.0]]), np.array([1, 1, 1, 2, 3]))
    assert best.id.tolist() == [1, 2]


def test_top_k_of_few_and_large(spark):
    df = vectors(spark, np.array([[1.0, 2.0], [3e9, -3e9], [3e9, 3e9]]))
    assert topk.top_k(df, df.where("vec_id = 0"), 20).count() == 2
    assert topk.top_k(df, df.where("vec_id = 1"), 1).first().vec_id == 2
    assert topk.top_k(df.limit(0), df.limit(0), 20).count() == 0


def test_large_scores_are_exact(spark):
    """Scores beyond 2^53, which doubles would round, and beyond the range of long."""
    x = [[(2.0**28 + 3) / 64, 1 / 64], [(2.0**28 + 1) / 64, 0.0], [(2.0**28 + 1) / 64, 2 / 64], [2.0**60, 0.0]]
    doubles = lambda x: spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    df = doubles(x[:3])
    whole = [[int(64 * v) for v in row] for row in x]
    want = sorted(((-sum(a * b for a, b in zip(whole[0], whole[i], strict=True)), i) for i in (1, 2)))
    assert [(-r.score, r.vec_id) for r in topk.top_k(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()] == want
    assert max(-s for s, _ in want) > 2**53
    big = doubles(x)
    with pytest.raises(Exception, match="does not fit into a long"):
        topk.top_k(big, big.where("vec_id = 3"), 1).collect()


def exact_share(x, asked, k=20):
    q = np.floor(64 * x[asked])
    return topk.search(asked, q, np.arange(len(x)), np.floor(64 * x), k)[1] / (len(asked) * len(x))


def test_bounds_prune():
    """Share of exact products: small on smooth vectors of clusters, and nearly all on noise, which no bound of segments tells apart."""
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(8000, 64))
    centres = np.repeat(rng.normal(size=(40, 8)), 8, axis=1)
    clustered = centres[rng.integers(0, 40, 8000)] + 0.2 * noise
    asked = np.arange(0, 8000, 20)
    assert exact_share(clustered, asked) < 0.2 and exact_share(noise, asked) <= 1


def test_top_k_equals_sql(spark, tables):
    assert rows_of(queries.op5_exact_top_k(spark, tables)) == rows_of_sql(connect(tables), queries.OP5_SQL)


def test_bounds_hold():
    x = np.random.default_rng(2).normal(size=(50, 30))
    for s in (1, 4, 7, 30, 99):
        assert (topk.statistics(x, s) @ topk.statistics(x, s).T + 1e-9 >= x @ x.T).all()


def test_neighbours_of_a_small_table_are_exact(spark):
    x = np.random.default_rng(3).normal(size=(60, 16)).astype(np.float32)
    df = vectors(spark, x, [*ODD, *SHORT, (1006, [0.0] * 16)])
    cosine = lambda a, b: float(a.astype(float) @ b.astype(float) / (np.linalg.norm(a.astype(float)) * np.linalg.norm(b.astype(float))))
    got = sorted(map(tuple, ann.search(df, df.where("vec_id % 50 = 0 and vec_id <> 1000"), 5).collect()))
    want = brute(x, (0, 50), 5, cosine)
    lone = ann.search(df, df.where("vec_id in (1020, 1050)"), 5).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in lone] == [(1020, 1004), (1020, 1040)] and abs(lone[0].score) < 1e-12
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert ann.search(df.limit(0), df.limit(0), 5).count() == 0
    few = df.where("vec_id < 3")
    assert ann.search(few, few.where("vec_id = 0"), 5).count() == 2


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, scale):
    """The registered query against all cosines."""
    folder = f"/root/testdata/{scale}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(rows["embedding"].tolist()).astype(np.float64), rows["vec_id"].to_numpy()
    u, got = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for r in queries.op8_ivf_pq(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for at in np.flatnonzero(ids % 50 == 0):
        s = (u * u[at]).sum(axis=1).round(12)
        s[at] = -2
        hits += len(got[ids[at]] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert hits / (5 * len(got)) >= 0.9 and len(got) == (ids % 50 == 0).sum()
    print(scale, "recall", hits / (5 * len(got)))


def test_recall(spark):
    x = np.random.default_rng(4).normal(size=(3000, 32)).astype(np.float32)
    df = vectors(spark, x)
    got = {}
    for r in ann.search(df, df.where(F.col("vec_id") % 50 == 0), 5, piece=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 300 >= 0.9


def recall(spark, x, asked, **how):
    """Share of the 5 nearest, smaller ids first among equal ones, that is found for each asked row."""
    df = vectors(spark, x)
    got = {}
    for r in ann.search(df, df.where(F.col("vec_id").isin(asked)), 5, **how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in asked:
        s = (u * u[q]).sum(axis=1).round(12)
        s[q] = -2
        hits += len(got[q] & set(np.lexsort((np.arange(len(x)), -s))[:5].tolist()))
    return hits / (5 * len(asked))


def test_recall_of_a_large_group_of_copies(spark):
    x = np.random.default_rng(6).normal(size=(3000, 32)).astype(np.float32)
    copies = np.random.default_rng(7).permutation(3000)[:1000]
    x[copies] = x[copies[0]]
    assert recall(spark, x, sorted(copies[:40].tolist())) == 1


def test_recall_of_clusters(spark):
    """Near copies that share a code: which of them are nearest only the exact cosine tells."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(4, 32))[rng.integers(0, 4, 3000)] + 1e-4 * rng.normal(size=(3000, 32))).astype(np.float32)
    assert recall(spark, x, list(range(0, 3000, 60)), lists=4) >= 0.95


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 6), (9, 9), (7, 8), (8, 3), (1, 2)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (4, 4), (5, 4), (6, 4)}
    chain = spark.range(60).selectExpr("id as u", "id + 1 as v")
    assert {r.root for r in components(chain).collect()} == {0}


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op5_exact_top_k", "op9_curriculum_mix"}))
def test_query_equals_sql(spark, tables, name):
    assert rows_of(queries.queries()[name](spark, tables)) == rows_of_sql(connect(tables), queries.oracle_sql()[name])
