"""Queries over boards, positions and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boards as B
from ..functions import text as T
from ..operators import images as I
from ..operators import positions as P
from .sources import BOARDS_SQL, SPARSE_SQL, boards, sparse_boards, table


def plausibility_golden(spark, d):
    """Boards of few pieces, many of them possible ones."""
    return sparse_boards(spark, d).select("id", F.array_join(B.issues(F.col("cells")), ",").alias("issues"))


def king_color_repair(spark, d):
    """Parts as boards of kings and pawns: the kings' ranks come from the keys, and some boards lack black pawns."""
    row = lambda n: F.when(F.col("w") == n, "...K").otherwise("....")
    rest = lambda n: F.when(F.col("b") == n, "k").otherwise(".")
    pawns = lambda n: F.lit("PPP") if n == 1 else F.when(F.col("p_partkey") % 5 > 0, "ppp").otherwise("...") if n == 6 else F.lit("...")
    rows = table(spark, d, "part").withColumns({"w": F.col("p_size") % 8, "b": F.col("p_partkey") % 8})
    cells = F.concat(*[F.concat(row(n), rest(n), pawns(n)) for n in range(7, -1, -1)])
    # the board is bound once, as its many uses would each build it anew
    both = F.transform(F.array(cells), lambda c: F.struct(c.alias("before"), B.repaired_kings(c).alias("after")))
    shown = F.transform(both, lambda b: F.struct(B.placement(b["after"]).alias("repaired"), (b["after"] != b["before"]).alias("swapped")))[0]
    return rows.select("p_partkey", shown.alias("x")).select("p_partkey", "x.*")


def squares64(spark, d):
    """Placements there and back: the boards of all vectors."""
    rows = boards(spark, d).withColumn("placement", B.placement(F.col("cells")))
    return rows.select("id", (B.squares(F.col("placement")) == F.col("cells")).alias("same"), F.length("placement").alias("n"), F.size(F.split("placement", "/")).alias("rows"))


def orientation_score(spark, d):
    turned = B.oriented(F.col("cells"))
    return boards(spark, d).select("id", F.round(B.white_bottom_score(F.col("cells")), 6).alias("score"), turned["flipped"].alias("flipped"), turned["sure"].alias("sure"), turned["cells"].alias("cells"))


def orientation_override(spark, d):
    flip = F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False)
    turned = B.oriented(F.col("cells"), flip)
    return boards(spark, d).select("id", turned["flipped"].alias("flipped"), turned["sure"].alias("sure"))


def colors_only_differ(spark, d):
    other = F.when(F.col("id") % 2 == 0, F.translate("cells", "KkNn", "kKnN")).otherwise(F.col("read"))
    return boards(spark, d).select("id", B.colours_only_differ(F.col("cells"), other).alias("differ"))


def piece_issues(spark, d):
    return boards(spark, d).select("id", F.array_join(B.issues(F.col("cells")), ",").alias("issues"))


def board_errors(spark, d):
    e = B.errors(F.col("read"), F.col("cells"))
    return boards(spark, d).select("id", e["ghost"].alias("ghost"), e["missing"].alias("missing"), e["wrong"].alias("wrong"), B.distance(F.col("read"), F.col("cells")).alias("off"))


def error_rollup(spark, d):
    return P.error_report(boards(spark, d).withColumn("truth", F.col("cells")))


def held_out_errors(spark, d):
    return P.held_out_report(boards(spark, d), F.col("book") >= 7)


def known_positions_semi(spark, d):
    known = P.known_positions(boards(spark, d).select(F.col("cells").alias("placement"), (F.col("id") % 3 > 0).alias("ok")), boards(spark, d).where("id % 30 = 0").select(F.col("cells").alias("placement")))
    return P.known_readings(boards(spark, d).select("id", F.col("read").alias("placement")), known).select("id")


def first_known_reading(spark, d):
    tries = boards(spark, d).select(F.col("id").alias("diagram"), F.posexplode(F.array(F.concat(F.lit("#"), F.substring("cells", 2, 63)), F.col("read"), F.col("cells"))).alias("place", "placement"))
    known = boards(spark, d).select(F.col("cells").alias("placement"))
    return P.first_known(tries, known).select("diagram", "place", "placement")


def diagram_move_match(spark, d):
    """Diagrams and moves on pages of 20 vectors; whole placements recur, as each vector shows one of the first 37 boards."""
    shown = boards(spark, d).where("id < 37").select(F.col("id").alias("which"), B.placement(F.col("cells")).alias("placement"))
    rows = boards(spark, d).select("id", F.floor(F.col("id") / 20).alias("page"), (F.col("id") * 11 % 37).alias("which")).join(F.broadcast(shown), "which")  # 37 rows
    diagrams = rows.where("id % 4 = 0").select(F.col("id").alias("diagram"), "page", "placement")
    played = rows.where("id % 4 = 1 and id % 3 > 0").select("page", "placement", F.col("id").alias("move"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), (F.col("id") % 8 == 1).alias("ok"))
    starts = rows.where("id % 20 = 2").select("page", "placement")
    return P.matched_moves(diagrams, played, starts)


def snap_nearest_margin(spark, d):
    return P.snapped(boards(spark, d).select(F.col("id").alias("reading"), F.col("read").alias("cells")), boards(spark, d))


def exemplar_nearest(spark, d):
    """Each vector against the ten vectors of smallest id of the labels."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    exemplars = rows.groupBy("label").agg(F.min_by("v", "id").alias("v")).select(F.col("label").alias("letter"), "v")
    return P.nearest_exemplar(rows, exemplars, 1.3).select("id", "letter", "distance")


def unique_argmax(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("score"))
    return P.unique_best(rows, "user_id", "score")


def shifted_boxes(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), (F.col("p_size") * 2).alias("y"), (80 + F.col("p_size")).alias("side"))
    return P.shifted_boxes(rows)


def fen_label(spark, d):
    full, side = (F.col("turn") + 2).cast("string"), F.when(F.col("turn") % 2 == 0, "w").otherwise("b")
    fen = F.concat_ws(" ", F.lit("8/8/8/8/8/8/8/8"), side, F.lit("KQ"), F.lit("e3"), F.lit("4"), full)
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", T.move_label(fen, F.lit("Nf3")).alias("label"), T.with_side(fen, F.lit("b"), F.col("turn") % 3 == 0).alias("fen"))


def board_gates(spark, d):
    """Trust gates of readings and gates of pictures, by the operators, over numbers that stand for metrics; the side of a dot."""
    v = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    rows = table(spark, d, "embeddings").withColumns({"aspect": v(1) / v(2), "score": v(3) * 20, "split": v(8), "confirmed": F.col("vec_id") % 7 == 0, "flawed": F.col("vec_id") % 5 == 0})
    shown = I.boards_only(rows)
    return shown.select("vec_id", I.search_finer(1 - v(4), F.col("flawed")).alias("search_finer"), I.second_reader(1 - v(5), F.col("confirmed"), v(6) / 20).alias("second_reader"), B.side_of_dot(v(7) * 4, F.col("label") % 2 == 0).alias("side"))


def mean_confidence(spark, d):
    squared = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.slice("embedding", i * 4 + 1, F.lit(4)), lambda x: F.bround(F.abs(x.cast("double")), 6)))
    return table(spark, d, "embeddings").select("vec_id", B.confidence(squared).alias("confidence"))


_ISSUES_SQL = """s AS (SELECT id, unnest(range(64)) AS i, cells FROM boards), p AS (SELECT id, i, substr(cells, i + 1, 1) AS c FROM s),
        n AS (SELECT id, count_if(c = 'K') AS wk, count_if(c = 'k') AS bk, count_if(c = 'P') AS wp, count_if(c = 'p') AS bp, count_if(c IN ('P','N','B','R','Q','K')) AS w, count_if(c IN ('p','n','b','r','q','k')) AS b,
              greatest(count_if(c = 'Q') - 1, 0) + greatest(count_if(c = 'R') - 2, 0) + greatest(count_if(c = 'B') - 2, 0) + greatest(count_if(c = 'N') - 2, 0) AS we,
              greatest(count_if(c = 'q') - 1, 0) + greatest(count_if(c = 'r') - 2, 0) + greatest(count_if(c = 'b') - 2, 0) + greatest(count_if(c = 'n') - 2, 0) AS be,
              count_if(c IN ('P','p') AND (i < 8 OR i >= 56)) AS edge FROM p GROUP BY id)
        SELECT id, array_to_string(list_filter([CASE WHEN w + b = 0 THEN 'empty' END, CASE WHEN bk = 0 THEN 'no_black_king' END, CASE WHEN wk = 0 THEN 'no_white_king' END, CASE WHEN edge > 0 THEN 'pawns_on_backrank' END,
            CASE WHEN bp > 8 THEN 'too_many_black_pawns' END, CASE WHEN b > 16 THEN 'too_many_black_pieces' END, CASE WHEN bp + be > 8 THEN 'too_many_black_pieces_for_pawns' END, CASE WHEN wk > 1 OR bk > 1 THEN 'too_many_kings' END,
            CASE WHEN wp > 8 THEN 'too_many_white_pawns' END, CASE WHEN w > 16 THEN 'too_many_white_pieces' END, CASE WHEN wp + we > 8 THEN 'too_many_white_pieces_for_pawns' END], lambda x: x IS NOT NULL), ',') AS issues FROM n"""

QUERIES = {
    "plausibility_golden": (plausibility_golden, f"WITH {SPARSE_SQL}, {_ISSUES_SQL}"),
    "king_color_repair": (king_color_repair, """WITH p AS (SELECT p_partkey, p_size % 8 AS w, p_partkey % 8 AS b, p_partkey % 5 > 0 AS armed FROM part),
        g AS (SELECT *, abs(w - 1) - abs(w - 6) AS gw, abs(b - 6) - abs(b - 1) AS gb FROM p), r AS (SELECT *, armed AND gw > 0 AND gb > 0 AND gw + gb >= 2 AS swapped FROM g),
        c AS (SELECT *, array_to_string(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda n: CASE WHEN w = n THEN CASE WHEN swapped THEN '...k' ELSE '...K' END ELSE '....' END || CASE WHEN b = n THEN CASE WHEN swapped THEN 'K' ELSE 'k' END ELSE '.' END
                 || CASE WHEN n = 1 THEN 'PPP' WHEN n = 6 AND armed THEN 'ppp' ELSE '...' END), '/') AS x FROM r)
        SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(replace(x, '........', '8'), '.......', '7'), '......', '6'), '.....', '5'), '....', '4'), '...', '3'), '..', '2'), '.', '1') AS repaired, swapped FROM c"""),
    "squares64": (squares64, f"""WITH {BOARDS_SQL}, r AS (SELECT id, cells, list_transform(range(8), lambda i: regexp_replace(substr(cells, 8 * i + 1, 8), '[.]+', '#', 'g')) AS rows FROM boards),
        n AS (SELECT id, CAST(sum(length(x)) + 7 AS INTEGER) AS n FROM (SELECT id, unnest(rows) AS x FROM r) GROUP BY id) SELECT id, true AS same, n, 8 AS rows FROM n"""),
    "orientation_score": (orientation_score, f"""WITH {BOARDS_SQL}, s AS (SELECT id, unnest(range(64)) AS i, cells FROM boards), p AS (SELECT id, substr(cells, i + 1, 1) AS c, 7 - i // 8 AS r FROM s),
        m AS (SELECT id, coalesce(avg(r) FILTER (WHERE c IN ('p','n','b','r','q','k')), 0) - coalesce(avg(r) FILTER (WHERE c IN ('P','N','B','R','Q','K')), 0) AS score FROM p GROUP BY id)
        SELECT m.id, round(score, 6) AS score, score < 0 AS flipped, abs(score) >= 2 AS sure, CASE WHEN score < 0 THEN reverse(cells) ELSE cells END AS cells FROM m JOIN boards b ON m.id = b.id"""),
    "orientation_override": (orientation_override, f"""WITH {BOARDS_SQL}, s AS (SELECT id, unnest(range(64)) AS i, cells FROM boards), p AS (SELECT id, substr(cells, i + 1, 1) AS c, 7 - i // 8 AS r FROM s),
        m AS (SELECT id, coalesce(avg(r) FILTER (WHERE c IN ('p','n','b','r','q','k')), 0) - coalesce(avg(r) FILTER (WHERE c IN ('P','N','B','R','Q','K')), 0) AS score FROM p GROUP BY id)
        SELECT id, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE score < 0 END AS flipped, id % 3 < 2 OR abs(score) >= 2 AS sure FROM m"""),
    "colors_only_differ": (colors_only_differ, f"WITH {BOARDS_SQL}, o AS (SELECT id, cells, CASE WHEN id % 2 = 0 THEN translate(cells, 'KkNn', 'kKnN') ELSE read END AS other FROM boards) SELECT id, cells <> other AND lower(cells) = lower(other) AS differ FROM o"),
    "piece_issues": (piece_issues, f"WITH {BOARDS_SQL}, {_ISSUES_SQL}"),
    "board_errors": (board_errors, f"""WITH {BOARDS_SQL}, s AS (SELECT id, unnest(range(64)) AS i, cells, read FROM boards), p AS (SELECT id, substr(cells, i + 1, 1) AS t, substr(read, i + 1, 1) AS r FROM s)
        SELECT id, CAST(count_if(t = '.' AND r <> '.') AS INTEGER) AS ghost, CAST(count_if(t <> '.' AND r = '.') AS INTEGER) AS missing, CAST(count_if(t <> '.' AND r <> '.' AND t <> r) AS INTEGER) AS wrong, CAST(count_if(t <> r) AS INTEGER) AS off FROM p GROUP BY id"""),
    "error_rollup": (error_rollup, f"""WITH {BOARDS_SQL}, s AS (SELECT id, book, unnest(range(64)) AS i, cells, read FROM boards), p AS (SELECT id, book, substr(cells, i + 1, 1) AS t, substr(read, i + 1, 1) AS r FROM s)
        SELECT book, count(DISTINCT id) AS boards, count_if(t = '.' AND r <> '.') AS ghost, count_if(t <> '.' AND r = '.') AS missing, count_if(t <> '.' AND r <> '.' AND t <> r) AS wrong FROM p GROUP BY ROLLUP (book)"""),
    "held_out_errors": (held_out_errors, f"""WITH {BOARDS_SQL}, s AS (SELECT id, book, unnest(range(64)) AS i, cells, read FROM boards), p AS (SELECT id, book, count_if(substr(cells, i + 1, 1) <> substr(read, i + 1, 1)) AS off FROM s GROUP BY ALL)
        SELECT count(*) AS boards, CAST(sum(off) AS BIGINT) AS off, CAST(sum(off) FILTER (WHERE book >= 7) AS BIGINT) AS off_held, count_if(off <= 3) AS usable FROM p"""),
    "known_positions_semi": (known_positions_semi, f"WITH {BOARDS_SQL} SELECT id FROM boards WHERE read IN (SELECT cells FROM boards WHERE id % 3 > 0 OR id % 30 = 0)"),
    "first_known_reading": (first_known_reading, f"WITH {BOARDS_SQL} SELECT id AS diagram, CASE WHEN read IN (SELECT cells FROM boards) THEN 1 ELSE 2 END AS place, CASE WHEN read IN (SELECT cells FROM boards) THEN read ELSE cells END AS placement FROM boards"),
    "diagram_move_match": (diagram_move_match, f"""WITH {BOARDS_SQL}, r AS (SELECT b.id, b.id // 20 AS page, k.cells AS placement FROM boards b JOIN boards k ON k.id = b.id * 11 % 37), m AS (SELECT * FROM r WHERE id % 8 = 1 AND id % 3 > 0),
        j AS (SELECT d.id AS diagram, d.page, d.placement, m.id AS move FROM r d LEFT JOIN m ON d.placement = m.placement WHERE d.id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY m.page <> d.page, m.page, m.id) = 1)
        SELECT diagram, j.page, coalesce('m' || move, CASE WHEN s.placement = j.placement THEN 'start' END) AS matches FROM j LEFT JOIN r s ON s.page = j.page AND s.id % 20 = 2"""),
    "snap_nearest_margin": (snap_nearest_margin, f"""WITH {BOARDS_SQL}, k AS (SELECT DISTINCT cells FROM boards), p AS (SELECT b.id, k.cells, hamming(b.read, k.cells) AS off FROM boards b, k),
        r AS (SELECT id AS reading, cells, off, lead(off) OVER w AS next, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY id ORDER BY off, cells)) SELECT reading, cells, CAST(off AS INTEGER) AS off FROM r WHERE n = 1 AND off <= 4 AND (next IS NULL OR next >= off + 2)"""),
    "exemplar_nearest": (exemplar_nearest, """WITH e AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
        p AS (SELECT vec_id, label, sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, e.label, CAST(v AS DOUBLE[]) AS b FROM embeddings, e))
        SELECT vec_id AS id, CASE WHEN min(d) <= 1.3 THEN arg_min(label, (d, label)) END AS letter, round_even(min(d), 6) AS distance FROM p GROUP BY vec_id"""),
    "unique_argmax": (unique_argmax, "WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS score FROM events), m AS (SELECT *, max(score) OVER (PARTITION BY user_id) AS best FROM e) SELECT user_id, min(event_id) AS event_id, min(score) AS score FROM m WHERE score = best GROUP BY user_id HAVING count(*) = 1"),
    "shifted_boxes": (shifted_boxes, "WITH s AS (SELECT unnest([0, -1, 1]) AS i), t AS (SELECT unnest([0, -1, 1]) AS j) SELECT p_partkey AS id, i, j, p_size + i * CAST(round_even((80 + p_size) / 8, 0) AS INTEGER) AS x, p_size * 2 + j * CAST(round_even((80 + p_size) / 8, 0) AS INTEGER) AS y, 80 + p_size AS side FROM part, s, t"),
    "fen_label": (fen_label, """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN (turn + 1) || '... Nf3' ELSE (turn + 2) || '. Nf3' END AS label, '8/8/8/8/8/8/8/8 b ' || CASE WHEN turn % 3 = 0 THEN 'KQ e3' ELSE '- -' END || ' 0 1' AS fen FROM conversations"""),
    "board_gates": (board_gates, """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings)
        SELECT vec_id, vec_id % 5 = 0 OR 1 - a[4] < 0.95 AS search_finer, vec_id % 7 > 0 AND 1 - a[5] < 0.99 AND a[6] / 20 < 0.002 AS second_reader, CASE WHEN (a[7] * 4 < 0.5) = (label % 2 = 0) THEN 'w' ELSE 'b' END AS side
        FROM v WHERE a[1] / a[2] BETWEEN 0.8 AND 1.25 AND a[3] * 20 >= 2.5 AND a[8] < 0.4"""),
    "mean_confidence": (mean_confidence, """WITH s AS (SELECT vec_id, unnest(range(16)) AS i, embedding AS e FROM embeddings), m AS (SELECT vec_id, i, list_max(list_transform(e[4 * i + 1:4 * i + 4], lambda x: round_even(abs(CAST(x AS DOUBLE)), 6))) AS b FROM s)
        SELECT vec_id, round_even(list_sum(list(b ORDER BY i)) / 16, 3) AS confidence FROM m GROUP BY vec_id"""),
}

