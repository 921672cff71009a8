"""Trees of moves against a plain walk over the tokens of a page, and the plan they take."""

import random

from plyframe.operators import tokens as N


def plain(tokens):
    level = low = 0
    last, opened, lines, out = {}, {}, {}, {}
    for idx, (kind, value) in enumerate(tokens):
        level += {"open": 1, "close": -1}.get(kind, 0)
        low = min(low, level)
        depth = level - low
        if kind == "open":
            opened[depth] = (idx, last.get(depth - 1))
        at, varied = opened[depth] if depth else (-1, None)
        line = lines.setdefault((depth, at), {"same": None, "ply": None})
        if kind == "num":
            line["ply"] = int(value.rstrip(".")) * 2 - (1 if value.endswith("...") else 2)
        elif kind == "move":
            out[idx] = (depth, line["ply"], varied if line["same"] is None else line["same"])
            line["same"] = last[depth] = idx
            line["ply"] = None if line["ply"] is None else line["ply"] + 1
    return out


def test_trees_of_random_tokens(spark):
    rng, rows, want = random.Random(3), [], {}
    for page in range(60):
        kinds = rng.choices(["move", "num", "open", "close", "prose"], [5, 2, 2, 2, 1], k=rng.randrange(1, 50))
        tokens = [(k, {"num": rng.choice(["3.", "4...", "12."]), "open": "(", "close": ")"}.get(k, "x")) for k in kinds]
        rows += [(page, i, k, v, i) for i, (k, v) in enumerate(tokens)]
        want |= {(page, i): t for i, t in plain(tokens).items()}
    found = N.variations(spark.createDataFrame(rows, "page int, idx int, kind string, value string, start int"))
    assert {(r.page, r.idx): (r.depth, r.ply, r.parent) for r in found.collect()} == want


def test_a_tree_needs_no_join(spark):
    toks = N.tokens(spark.createDataFrame([(1, "1. e4 e5 (1... c5 2. Nf3) 2. Nc3")], "page int, text string"), "en")
    plan = N.variations(toks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate ") == toks._jdf.queryExecution().optimizedPlan().toString().count("Generate ")
