"""Small cases of operators and functions with known outcomes."""

import hashlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe import catalog
from plyframe.functions import boards as B
from plyframe.functions import geometry as G
from plyframe.functions import text as T
from plyframe.operators import blocks as K
from plyframe.operators import alignment
from plyframe.operators import images as I
from plyframe.operators import positions as P
from plyframe.operators import reader
from plyframe.operators import spatial as S
from plyframe.operators import tables as R
from plyframe.operators import tokens as N
from plyframe.sources import archive, layer
from plyframe.streaming import progress

WHITE_BELOW = ("r3k2r/ppp2ppp/2n5/8/8/2N5/PPP2PPP/R3K2R", "6k1/5ppp/8/8/8/8/5PPP/6K1", "8/5k2/8/4p3/4P3/8/5K2/8")
BLACK_BELOW = ("R2K3R/PPP2PPP/5N2/8/8/5n2/ppp2ppp/r2k3r", "1K6/PPP5/8/8/8/8/ppp5/1k6")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def blocks(spark, *texts, labels=None):
    rows = [(1, i, (labels or ["text"] * len(texts))[i], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page int, ord int, label string, text string")


@pytest.mark.parametrize("placement,flipped", [*((p, False) for p in WHITE_BELOW), *((p, True) for p in BLACK_BELOW)])
def test_orientation_is_never_sure_and_wrong(spark, placement, flipped):
    got = one(spark, B.oriented(B.squares(F.lit(placement))))
    assert got.flipped == flipped or not got.sure


def test_orientation_follows_printed_coordinates(spark):
    got = one(spark, B.oriented(B.squares(F.lit(WHITE_BELOW[0])), F.lit(True)))
    assert got.flipped and got.sure and got.cells == one(spark, B.squares(F.lit(WHITE_BELOW[0])))[::-1]


def test_squares_and_back(spark):
    for p in WHITE_BELOW + BLACK_BELOW:
        cells = one(spark, B.squares(F.lit(p)))
        assert len(cells) == 64 and one(spark, B.placement(F.lit(cells))) == p


def test_dedupe_cuts_a_tail_with_misread_words(spark):
    tail = "15.Qd2 Nf6 16.Rad1 Rfd8 17.Bg5 h6 18.Bxf6 Bxf6 19.Ne4 Be7 20.Qc3 Nb4 21.Rxd8 Rxd8 22.a3 Nd5 23.Qc1 Nf4"
    other = "The game went on like this: " + tail
    a = "14.a4! keeps the pressure. " + other.replace("The game went", "Tne gane wemt")
    got = {r.ord: r.text for r in K.dedupe(blocks(spark, a, other)).collect()}
    assert got == {0: "14.a4! keeps the pressure.", 1: other}


def test_dedupe_leaves_unrelated_blocks_and_is_idempotent(spark):
    df = blocks(spark, "1.e4 e5 2.Nf3 Nc6 and so on for a while", "A wholly different paragraph about endgames")
    assert sorted(K.dedupe(df).collect()) == sorted(df.collect()) == sorted(K.dedupe(K.dedupe(df)).collect())


def test_a_window_at_the_very_start_cuts_nothing(spark):
    """The block begins with a later part of the other one and holds its start further on: it stays whole."""
    other = "".join(f"{i:03d}abcdefg" for i in range(20))
    own = other[30:90] + " and then " + other[30:]
    assert [r.text for r in K.dedupe(blocks(spark, own, other)).orderBy("ord").collect()] == [own, other]
    assert K.before_run_on("x" * 9 + other, other) == 9 and K.before_run_on(other, other) is None and K.before_run_on("", other) is None


@pytest.mark.parametrize("ranks,files,want", [
    ([8, 7, 6, 5], "abcd", False), ([1, 2, 3, 4], "hgfe", True), ([8, 7, 6], "", False), ([8, 7], "a", None), ([8, 7, 6], "hgf", None), ([8, 7, 5, 6, 4], "abdc", False), ([], "", None),
])
def test_printed_coordinates(spark, ranks, files, want):
    """White below, Black below, ranks only, too few, contradictory, noisy, none; and signs in the middle, which do not count."""
    rows = [(1, i, 5.0, 100.0 * (i + 1), str(r)) for i, r in enumerate(ranks)] + [(1, 50 + i, 100.0 * (i + 1), 995.0, f) for i, f in enumerate(files)] + [(1, 90 + i, 500.0, 100.0 * i, str(i)) for i in range(1, 9)]
    pieces = spark.createDataFrame(rows, "page int, line int, cx double, cy double, text string")
    boxes = spark.createDataFrame([(1, 7)], "page int, box int").withColumn("bbox", G.box(*[F.lit(float(v)) for v in (0, 0, 1000, 1000)]))
    assert S.printed_orientation(pieces, boxes).first().flipped is want


def test_inserted_lines_hold_later_ones(spark):
    rows = [(1, 1, 50.0, 50.0, True), (1, 2, 55.0, 52.0, True), (1, 3, 50.0, 90.0, True), (1, 4, 500.0, 500.0, True), (1, 5, 300.0, 50.0, False), (2, 6, 50.0, 50.0, True)]
    lines = spark.createDataFrame(rows, "page int, line int, cx double, cy double, has_moves boolean").withColumn("bbox", G.box(F.col("cx") - 30, F.col("cy") - 10, F.col("cx") + 30, F.col("cy") + 10))
    boxes = spark.createDataFrame([(1, 1)], "page int, box int").withColumn("bbox", G.box(*[F.lit(float(v)) for v in (450, 450, 600, 600)]))
    assert sorted(r.line for r in S.orphan_moves(lines, boxes).collect()) == [1, 3, 6]


def test_many_exemplars_are_split(spark):
    rng = np.random.default_rng(1)
    rows = lambda n, name: spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(n, 4)))], f"{name} int, v array<double>")
    glyphs, exemplars = rows(40, "id"), rows(30, "letter")
    one_group, groups = (sorted(P.nearest_exemplar(glyphs, exemplars, 1.0, n).collect()) for n in (1024, 7))
    assert one_group == groups and len(groups) == 40


def test_entities(spark):
    assert one(spark, T.unescaped(F.lit("a&eacute;b &amp; &#8217;&hellip;"))) == "aéb & ’…"


def test_aligned_characters(spark):
    rows = [("abcdef", "abXdef", 5 / 6), ("abc", "", 0.0), (None, "abc", 0.0), ("", "", 0.0), ("aab", "baa", 2 / 3)]
    got = alignment.aligned_share(spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")).orderBy("i").collect()
    assert [r.share for r in got] == [w for _, _, w in rows] and [r.placed for r in got] == [w >= 0.6 for _, _, w in rows]


def test_footer_with_a_move_is_text(spark):
    got = K.footers_to_text(blocks(spark, "27...Cd7", "page 12", labels=["footer", "footer"])).orderBy("ord").collect()
    assert [r.label for r in got] == ["text", "footer"]


def test_sparse_needs_three_blocks(spark):
    df = blocks(spark, "abc", "x" * 900, "x" * 900, "x" * 900).withColumn("bbox", G.box(F.lit(0), F.lit(0), F.lit(400), F.lit(300)))
    assert [r.ord for r in K.sparse(df).where("sparse").collect()] == [0]
    assert K.sparse(df.where("ord < 2")).where("sparse").count() == 0


def test_stray_bracket_and_labels(spark):
    kinds = lambda text: [(r.kind, r.value) for r in N.tokens(spark.createDataFrame([(1, text)], "page int, text string"), "fr").orderBy("idx").collect()]
    assert kinds("57.Ff1=, B) 56.Ff2")[2:4] == [("semi", ";"), ("prose", "")]
    assert ("close", ")") not in kinds("A) 1.e4") and ("close", ")") in kinds("(1.e4)")
    assert kinds("Ff40-0 12.0-0")[-2:] == [("num", "12."), ("move", "0-0")]


def test_tokens_are_ordered_and_slice_the_text(spark):
    text = "12.Cf3 Cc6 [12...d5 13.exd5] 13.Fb5 a6!? suivi de 14.Fa4; 1-0"
    rows = N.tokens(spark.createDataFrame([(1, text)], "page int, text string"), "fr").orderBy("idx").collect()
    assert all(text[r.start : r.end] == r.value for r in rows if r.kind != "prose")
    assert all(a.end <= b.start for a, b in zip(rows, rows[1:], strict=False))


def test_merged_rows(spark):
    boxes = F.array(*[G.box(*[F.lit(float(v)) for v in b]) for b in ((0, 0, 10, 10), (12, 1, 20, 11), (0, 40, 8, 50))])
    assert one(spark, S.merged_rows(boxes)) == [[-2, -2, 24, 15], [-2, 38, 12, 14]]


def test_snap_keeps_a_margin(spark):
    cells = "P" * 64
    near, far = "." + cells[1:], "..." + cells[3:]
    readings = spark.createDataFrame([(1, cells)], "reading int, cells string")
    known = lambda *k: spark.createDataFrame([(x,) for x in k], "cells string")
    assert P.snapped(readings, known(near, far)).first().cells == near
    assert P.snapped(readings, known(near, ".." + cells[2:])).count() == 0
    assert P.snapped(readings, known("." * 5 + cells[5:])).count() == 0


def test_corrections_hold_only_for_their_value(spark):
    diagrams = spark.createDataFrame([("p1_d1", "old"), ("p1_d2", "old")], "id string, fen string")
    made = spark.createDataFrame([("p1_d1", "diagram_fen", "new", "old"), ("p1_d2", "diagram_fen", "new", "older")], "target string, type string, value string, of string").withColumn("source_hash", T.content_hash(F.col("of"))).drop("of")
    got = {r.id: (r.value, r.corrected, r.needs_review) for r in R.effective(diagrams, made).collect()}
    assert got == {"p1_d1": ("new", True, False), "p1_d2": ("old", False, True)}


def test_page_numbers_keep_order_and_repeats(spark):
    specs = spark.createDataFrame([("3,1-2,2,9",)], "spec string")
    assert [r.page for r in K.page_numbers(specs, 8).orderBy("place").collect()] == [3, 1, 2, 2]


def test_picture_metrics(spark, tmp_path):
    cells = (np.add.outer(np.arange(160) // 20, np.arange(160) // 20) % 2 * -150 + 240).astype(np.uint8)
    red = np.full((160, 160, 3), 250, np.uint8)
    red[:, :, 1:] = 20
    (tmp_path / "board.png").write_bytes(I.png(np.repeat(cells[:, :, None], 3, axis=2)))
    (tmp_path / "red.png").write_bytes(I.png(red))
    pictures = spark.read.format("image").load(str(tmp_path)).select(F.regexp_extract("image.origin", r"(\w+)\.png", 1).alias("id"), "image")
    got = {r.id: r for r in I.metrics(pictures).collect()}
    assert got["board"].score > 2.5 and got["board"].aspect == 1 and got["board"].vivid == 0 and abs(got["board"].side - 160) < 20
    assert got["red"].vivid == 1 and got["red"].score < 1


@pytest.mark.parametrize("seed", range(4))
def test_boards_are_found_anywhere(seed):
    rng = np.random.default_rng(seed)
    cell = int(rng.integers(22, 45))
    side = 8 * cell
    page = np.full((side + int(rng.integers(20, 120)), side + int(rng.integers(20, 120))), 250.0)
    x, y = (int(rng.integers(0, n - side)) for n in (page.shape[1], page.shape[0]))
    page[y : y + side, x : x + side] = np.add.outer(np.arange(side) // cell, np.arange(side) // cell) % 2 * -140 + 240
    score, fx, fy, found = I.find_board(page)
    assert score >= 2.5 and max(abs(fx - x), abs(fy - y), abs(found - side)) <= cell / 4
    assert I.find_board(page * 0 + 200)[0] < 2.5


def test_scores_equal_a_plain_computation():
    g = np.random.default_rng(5).uniform(0, 255, (90, 100))
    total = I.prefix_sums(g)
    for x, y, side in ((3, 5, 80), (0, 0, 64), (17, 2, 71)):
        cells = np.zeros((8, 8))
        for i in range(8):
            for j in range(8):
                ends = lambda o, k, f: (int(np.rint(o + (k + f) * side / 8)), int(np.rint(o + (k + f + 0.22) * side / 8)))
                cells[i, j] = np.mean([g[slice(*ends(y, i, fy)), slice(*ends(x, j, fx))].mean() for fx in (0.12, 0.66) for fy in (0.12, 0.66)])
        off = cells - cells.mean()
        c = abs(sum(off[i, j] * (-1) ** (i + j) for i in range(8) for j in range(8)))
        assert abs(I.checker_scores(total, *(np.array([v]) for v in (x, y, side)))[0] - c / np.abs(off).sum() * np.log1p(c)) < 1e-6


def test_pixel_shares():
    rgb = np.full((80, 80, 3), 255.0)
    rgb[:40, :, 2] = 60  # bright and saturated
    rgb[40:, :40] = (240, 200, 160)  # wood: bright, not saturated
    assert I.vivid_share(rgb) == 0.5
    board = np.full((80, 80), 250.0)
    assert I.split_share(board) == 0
    board[40, ::2] = board[::2, 41] = 0
    assert 0.4 <= I.split_share(board) <= 0.55
    dark = I.cell_darkness(np.where(np.add.outer(np.arange(80) // 10, np.arange(80) // 10) % 2, 0.0, 250.0))
    assert (dark == np.add.outer(np.arange(8), np.arange(8)) % 2).all()
    assert I.figurine_like(np.pad(np.full((30, 3), 255), ((0, 0), (5, 5)))) and not I.figurine_like(np.full((30, 20), 255)) and not I.figurine_like(np.zeros((20, 9)))


def test_flattening():
    assert I.flattened(np.array([90.0, 150.0, 240.0])).tolist() == [90, 200, 240]


def marked_board():
    """A board of 8 x 8 squares of 10 pixels with a dark piece, a highlighted square with a soft edge and a soft pixel far from it."""
    dark = np.add.outer(np.arange(80) // 10, np.arange(80) // 10) % 2 == 1
    plain = np.where(dark[:, :, None], np.array([150.0, 110, 80]), np.array([240.0, 220, 190]))
    board = plain.copy()
    board[33:37, 33:37] = 20
    want = board.copy()
    board[10:20, 20:30] = (250, 240, 40)
    board[12:18, 30:32] = (235, 200, 140)
    board[60, 60] = want[60, 60] = (235, 200, 140)
    return board, want


def test_marks_give_way_to_plain_squares():
    board, want = marked_board()
    assert (I.unmarked(board) == want).all() and (I.unmarked(want) == want).all()
    rng = np.random.default_rng(7)
    noisy = rng.integers(0, 256, (41, 37, 3)).astype(float)
    plain, got = I.plain_squares(noisy), I.unmarked(noisy)
    square = lambda y, x: (y * 8 // 41 + x * 8 // 37) % 2
    places = [(y, x) for y in range(41) for x in range(37)]
    middle = [np.median([noisy[p] for p in places if square(*p) == k], axis=0) for k in (0, 1)]

    def like(y, x, s, v, d):
        high, low = noisy[y, x].max(), noisy[y, x].min()
        return (high - low) / max(high, 1) > s and high > v and np.linalg.norm(noisy[y, x] - middle[square(y, x)]) > d

    marks = {p for p in places if like(*p, 0.5, 120, 60)}
    near = {(y + i, x + j) for y, x in marks for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) <= 2}
    for p in places:
        assert (plain[p] == middle[square(*p)]).all()
        assert (got[p] == (middle[square(*p)] if p in marks or (p in near and like(*p, 0.3, 150, 30)) else noisy[p])).all()


def test_pictures_are_written_and_read_again(spark, tmp_path):
    board, want = marked_board()
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in/a.png").write_bytes(I.png(board))
    read = lambda name: spark.read.format("image").load(str(tmp_path / name)).select(F.regexp_extract("image.origin", r"(\w+)\.png", 1).alias("id"), "image")
    pictures = read("in")
    boxes = spark.createDataFrame([("a", "c", 30, 30, 10, 8), ("a", "edge", 75, -5, 50, 10), ("a", "none", 200, 0, 5, 5), ("b", "lost", 0, 0, 5, 5)], "id string, name string, x int, y int, width int, height int")
    made = {r.name: r.bytes for r in I.crops(pictures, boxes).collect()} | {r.id: r.bytes for r in I.neutralized(pictures).collect()}
    assert set(made) == {"c", "edge", "none", "a"} and made.pop("none") is None
    for name, content in made.items():
        (tmp_path / f"out/{name}.png").write_bytes(content)
    got = {r.id: I.pixels(r.image.asDict()) for r in read("out").collect()}
    assert (got["c"] == board[30:38, 30:40]).all() and (got["edge"] == board[:5, 75:]).all() and (got["a"] == want).all()
    empty = spark.createDataFrame([("a", None)], pictures.schema)
    assert [r.bytes for r in I.neutralized(empty).collect()] == [None]


def test_titles(spark):
    rows = [(1, "/x/Best Games.v2.pdf", "Mine", "Meta"), (2, "/x/a.pdf", "", "Meta"), (3, "/x/Best Games.v2.pdf", None, ""), (4, "b/.hidden", None, None), (5, "plain", None, None), (6, "x/a.", None, None), (7, None, None, None)]
    got = {r.book: r.title for r in R.titled(spark.createDataFrame(rows, "book int, path string, given string, title string")).collect()}
    assert got == {1: "Mine", 2: "Meta", 3: "Best Games.v2", 4: ".hidden", 5: "plain", 6: "a.", 7: None}


def test_overall_progress(spark):
    rows = [(1, 10, "read", None), (1, 75, "write", None), (1, 80, "noise", None), (2, 0, "read", None), (2, 61, None, 0), (3, 5, None, 3), (4, 1, "noise", None)]
    got = {r.run: tuple(r)[1:] for r in progress.overall(spark.createDataFrame(rows, "run int, at long, label string, code int"), ("read", "write")).collect()}
    assert got == {1: (2, 2, "01:10", "running", None), 2: (1, 2, "01:01", "done", 0), 3: (None, 2, "00:00", "stopped", 3), 4: (None, 2, "00:00", "running", None)}


def test_archive_round_trip(spark, tmp_path):
    blocks = spark.createDataFrame([("b", 3, 0, "p3_t1", "1.e4")], "book string, page int, ord int, id string, text string")
    moves = spark.createDataFrame([("b", 3, 0, "p3_m1", "e4", True)], "book string, page int, ord int, id string, san string, ok boolean")
    sizes = spark.createDataFrame([("b", 3, 800, 1200)], "book string, page int, width int, height int")
    extra = spark.createDataFrame([("b", "manifest.json", bytearray(b'{"schema_version": 1, "title": "T", "page_count": 1}')), ("b", "corrections.json", bytearray(b'{"corrections": [{"target": "p3_d1", "type": "diagram_fen", "value": "x", "source_hash": "y"}]}'))], "book string, name string, bytes binary")
    book = archive.archives(archive.page_documents(blocks, moves, sizes).unionByName(extra)).first()
    (tmp_path / "b.chessbook").write_bytes(book.content)
    (tmp_path / "bad.chessbook").write_bytes(b"no archive")
    rows = archive.members(spark, str(tmp_path))
    page = archive.pages(rows).first()
    assert (page.page, page.width, page.blocks[0].text, page.moves[0].san) == (3, 800, "1.e4", "e4")
    assert archive.manifests(rows).first().dpi == 200 and archive.corrections(rows).first().target == "p3_d1"
    new = rows.where("name <> 'corrections.json'")
    again = archive.carried_over(new, rows).unionByName(rows.limit(0))
    assert archive.corrections(again).first().value == "x" and archive.carried_over(rows, rows).count() == rows.count()
    assert io.BytesIO(book.content).getvalue()[:2] == b"PK"


def test_checked_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"other")
    digest = hashlib.sha256(b"abc").hexdigest()
    sums = spark.createDataFrame([("a.bin", digest.upper()), ("b.bin", digest), ("c.bin", digest), ("a.bin", None)], "file string, sha256 string")
    assert sorted((r.file, r.ok) for r in archive.checked_files(spark, str(tmp_path), sums).collect()) == [("a.bin", False), ("a.bin", True), ("b.bin", False), ("c.bin", False)]


def plain_tokens(text, lang):
    """(start, end, value) of a text by Python's regular expressions; without labels of alternatives."""
    return [(m.start(), m.end(), m.group()) for m in re.finditer(N.token_pattern(lang).replace(r"\z", r"\Z"), text)]


def test_tokens_of_whole_documents(spark, tables):
    """The registered query over all texts against a search of each text by itself."""
    got = {}
    for r in catalog.queries()["document_tokens"](spark, tables).orderBy("page", "idx").collect():
        got.setdefault(r.page, []).append((r.start, r.end, r.value, r.kind))
    for doc in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect():
        own = got.get(doc.doc_id, [])
        want = [t for t in plain_tokens(doc.text or "", "en") if t[2] != ")"]
        assert [t[:3] for t in own if t[3] not in ("prose", "close") and (t[3], t[2]) != ("semi", ";")] == [t for t in want if t[2] not in ("]", ";")]


def test_text_layer(spark):
    markup = '<line><word xMin="36" yMin="72" xMax="72" yMax="90">A&amp;B</word> <word xMin="80" yMin="72" xMax="100" yMax="90">c4</word></line>'
    got = layer.blocks(spark.createDataFrame([(1, markup)], "page int, markup string")).first()
    assert got.text == "A&B c4" and (got.bbox.x0, got.bbox.y0, got.bbox.x1) == (100, 200, 278)
    assert [(w.start, w.end) for w in layer.words(spark.createDataFrame([(1, markup)], "page int, markup string")).orderBy("word").collect()] == [(0, 3), (4, 6)]


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("@@PROGRESS\tread\t1\t4\tx\nnoise\n@@PROGRESS\tread\t3\t4\ty\n@@PROGRESS\twrite\t0\t0\t\n")
    query = progress.watch(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.label, r.i, r.share) for r in spark.table("latest").collect()} == {("read", 3, 0.75), ("write", 0, 0.0)}


def test_pages_are_processed_once(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    pages = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):
        progress.process_new_pages(pages(), lambda df: df, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    spark.range(3, 5).write.mode("append").parquet(str(tmp_path / "in"))
    progress.process_new_pages(pages(), lambda df: df, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_members_of_many_pages(spark):
    rows = spark.sql("SELECT explode(array(7, 9999, 10000, 10003, 1234567)) AS p").select(T.member_name("pages", F.col("p"), ".json"))
    assert [r[0] for r in rows.collect()] == ["pages/p0007.json", "pages/p9999.json", "pages/p10000.json", "pages/p10003.json", "pages/p1234567.json"]


def test_the_nearest_exemplar_before_rounding(spark):
    exemplars = spark.createDataFrame([("a", [1.0000002]), ("b", [1.0000001])], "letter string, v array<double>")
    glyphs = spark.createDataFrame([(1, [0.0]), (2, [-0.2999999])], "id int, v array<double>")
    for per_group in (1, 1024):
        found = {r["id"]: (r["letter"], r["distance"]) for r in P.nearest_exemplar(glyphs, exemplars, 1.29999995, per_group).collect()}
        assert found == {1: ("b", 1.0), 2: (None, 1.3)}
