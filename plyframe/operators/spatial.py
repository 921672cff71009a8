"""Joins of spans, points and boxes.  Every join has an equality on the page, so that pages spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FULL_PAGE_SHARE, LINE_TOLERANCE, MARGIN_SHARE, MAX_IMAGE_PIXELS, MAX_IMAGES, NEAREST_BOXES, RECT_PAD, ROW_BUCKET, ROW_SHARE, TREND_LEAST, TREND_POINTS
from ..functions import geometry as G
from ..functions import text as T
from ..functions.sweep import nearest_below, parts_of_strips, sums_in_ranges

#: Side in pixels of the cells of a page that turn a range join into an equality join.
BAND = 128

#: Pairs of signs and boxes that are looked at together, and from which on their evidence makes a batch.
SWEPT_PAIRS = 1 << 18

# Points that a text object may lie beside its line, and what names of bold fonts hold.
STYLE_TOLERANCE, BOLD_FONT = 1, r"(?i)bold|black|heavy"

#: A variance below this share of the squares it is the rest of is none.
NO_SPREAD = 1e-13


def spans_in_blocks(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, ord, s, e, begin, end): each span with the block that holds it, and its place there; others are dropped.

    Blocks of a page do not overlap, so the holder is the last block that begins at or before the span: one running
    maximum over spans and blocks in order, no range join.
    """
    both = blocks.select("page", F.col("a").alias("at"), F.lit(0).alias("kind"), F.struct("ord", "a", "b").alias("block"), F.lit(None).cast("long").alias("e"))
    both = both.unionByName(spans.select("page", F.col("s").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(both.schema["block"].dataType).alias("block"), F.col("e").cast("long").alias("e")))
    order = Window.partitionBy("page").orderBy("at", "kind", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("holder", F.last("block", True).over(order)).where((F.col("kind") == 1) & (F.col("e") <= F.col("holder.b")))
    return held.select("page", F.col("holder.ord").alias("ord"), F.col("at").alias("s"), "e", (F.col("at") - F.col("holder.a")).alias("begin"), (F.col("e") - F.col("holder.a")).alias("end"))


def _celled(boxes: DataFrame, tolerance: float) -> DataFrame:
    """Boxes with a row for each cell of the page's grid that they touch."""
    def cells(low: str, high: str):
        first, last = F.floor((F.col(f"bbox.{low}") - tolerance) / BAND), F.floor((F.col(f"bbox.{high}") + tolerance) / BAND)
        return F.explode(F.sequence(first, F.greatest(first, last)))

    return boxes.withColumn("_row", cells("y0", "y1")).withColumn("_column", cells("x0", "x1"))


def _in_cell(points: DataFrame) -> DataFrame:
    return points.withColumns({"_row": F.floor(F.col("cy") / BAND), "_column": F.floor(F.col("cx") / BAND)})


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Pairs of a line (page, line, cx, cy, ...) and a box (page, box, bbox) that holds its centre."""
    joined = _in_cell(lines).join(_celled(boxes, tolerance), ["page", "_row", "_column"]).drop("_row", "_column")
    return joined.where(G.holds(F.col("bbox"), F.col("cx"), F.col("cy"), tolerance))


def lines_outside(lines: DataFrame, boxes: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """The lines whose centre no box of the page holds."""
    near = _celled(boxes, tolerance).select(F.col("page").alias("b_page"), F.col("_row").alias("b_row"), F.col("_column").alias("b_column"), F.col("bbox").alias("b_box"))
    cell = (F.col("page") == F.col("b_page")) & (F.col("_row") == F.col("b_row")) & (F.col("_column") == F.col("b_column"))
    return _in_cell(lines).join(near, cell & G.holds(F.col("b_box"), F.col("cx"), F.col("cy"), tolerance), "left_anti").drop("_row", "_column")


def reading_order(held: DataFrame, text: str = "text") -> DataFrame:
    """(page, box, text): lines by row bucket, then left to right, joined by blanks."""
    parts = F.array_sort(F.collect_list(F.struct(F.bround(F.col("cy") / ROW_BUCKET).alias("row"), F.col("cx").alias("x"), F.col(text).alias("t"))))
    return held.groupBy("page", "box").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def _nearest(strict: bool, own: bool):
    """Column function of sorted boxes (x0, x1, y) and intervals (q0, q1, least), arrays of one page: index of each interval's nearest box."""

    @F.pandas_udf("array<int>")
    def run(x0: pd.Series, x1: pd.Series, y: pd.Series, q0: pd.Series, q1: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([nearest_below(*map(np.asarray, page), strict, own).astype(np.int32) for page in zip(x0, x1, y, q0, q1, least, strict=True)])

    return run


def _values(rows: str, field: str) -> Column:
    return F.transform(rows, lambda r: r[field].cast("double"))


def next_below(orphans: DataFrame, blocks: DataFrame) -> DataFrame:
    """`before`: for each line (page, line, bbox) the ord of the text block (page, ord, label, text, bbox) that comes after it.

    That is the nearest block with text whose top is below the line's centre and that shares its width; null at the end of a page.
    The boxes of a page are one row, swept from bottom to top.
    """
    texts = blocks.where((F.col("label") == "text") & F.col("text").rlike(r"\S"))
    held = texts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("bbox.y0").alias("y"), "ord", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1")))).alias("boxes"))
    middle = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    asked = orphans.groupBy("page").agg(F.collect_list(F.struct("line", F.col("bbox.x0").alias("q0"), F.col("bbox.x1").alias("q1"), middle.alias("least"))).alias("lines"))
    pages = asked.join(held, "page", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(held.schema["boxes"].dataType)))
    found = _nearest(True, False)(*[_values("boxes", c) for c in ("x0", "x1", "y")], *[_values("lines", c) for c in ("q0", "q1", "least")])
    each = pages.select("page", "boxes", F.explode(F.arrays_zip("lines", found.alias("hit"))).alias("z"))
    return each.select("page", "z.lines.line", F.get("boxes", F.col("z.hit"))["ord"].alias("before"))


def clipped_words(words: Column, s: Column, e: Column) -> Column:
    """Boxes of the words (start, end, x0, y0, x1, y1) that a span overlaps, cut in proportion."""
    hit = F.filter(words, lambda w: (w["end"] > s) & (w["start"] < e))

    def cut(w: Column) -> Column:
        size, width = F.greatest(w["end"] - w["start"], F.lit(1)), w["x1"] - w["x0"]
        at = lambda p: w["x0"] + width * (p - w["start"]) / size
        return G.box(at(F.greatest(s, w["start"])), w["y0"].cast("double"), at(F.least(e, w["end"])), w["y1"].cast("double"))

    return F.transform(hit, cut)


def merged_rows(boxes: Column) -> Column:
    """One padded rectangle [x, y, w, h] per row of text: a box joins the first row whose middle it is near, in order."""
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    near = lambda r, b: F.abs((r["y0"] + r["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) < (r["y1"] - r["y0"]) * ROW_SHARE
    union = lambda r, b: G.box(F.least(r["x0"], b["x0"]), F.least(r["y0"], b["y0"]), F.greatest(r["x1"], b["x1"]), F.greatest(r["y1"], b["y1"]))

    def step(rows: Column, b: Column) -> Column:
        place = F.array(F.coalesce(F.array_position(F.transform(rows, lambda r: near(r, b)), True), F.lit(0)))
        joined = lambda at: F.transform(rows, lambda r, i: F.when(i == at - 1, union(r, b)).otherwise(r))
        return F.transform(place, lambda at: F.when(at > 0, joined(at)).otherwise(F.concat(rows, F.array(b))))[0].cast(kind)

    rows = F.aggregate(boxes, F.array().cast(kind), step)
    return F.transform(rows, lambda r: F.array(*[F.bround(v).cast("int") for v in (r["x0"] - RECT_PAD, r["y0"] - RECT_PAD, r["x1"] - r["x0"] + 2 * RECT_PAD, r["y1"] - r["y0"] + 2 * RECT_PAD)]))


def mode_first(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, votes): the most frequent value of each key, the first seen among equals."""
    votes = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("seen"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), "seen", value))
    return votes.withColumn("rank", rank).where("rank = 1").select(key, value, "votes")


def line_styles(objects: DataFrame, lines: DataFrame, tolerance: float = STYLE_TOLERANCE) -> DataFrame:
    """(page, box, bold, color): the most frequent style of the text objects whose centre a line (page, box, bbox) holds, the first seen among equals.

    Objects are (page, seq, cx, cy, font, red, green, blue); a font is bold by its name.  Lines without an object have no row.
    """
    style = F.struct(F.col("font").rlike(BOLD_FONT).alias("bold"), T.rgb_hex(F.col("red"), F.col("green"), F.col("blue")).alias("color"))
    held = lines_in_boxes(objects.select("page", "seq", "cx", "cy", style.alias("style")), lines, tolerance)
    best = mode_first(held.select(F.struct("page", "box").alias("key"), "style", "seq"), "key", "style", "seq")
    return best.select("key.*", "style.*")


def allowed_heights(boxes: DataFrame, share: float = 0.6) -> DataFrame:
    """`allowed`: the least room (page, box) has down to a box that shares its width and begins below `share` of its height.

    The boxes of a page are one row, swept from bottom to top.
    """
    one = F.struct(F.col("bbox.y0").alias("y"), "box", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"), (F.col("bbox.y0") + share * (F.col("bbox.y1") - F.col("bbox.y0"))).alias("least"))
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(one)).alias("boxes"))
    columns = ("x0", "x1", "y", "x0", "x1", "least")
    hit = _nearest(False, True)(*[_values("boxes", c) for c in columns])
    each = pages.select("page", "boxes", F.explode(F.arrays_zip(F.col("boxes").alias("own"), hit.alias("hit"))).alias("z"))
    return each.select("page", "z.own.box", (F.get("boxes", F.col("z.hit"))["y"] - F.col("z.own.y")).alias("allowed"))


def crop_grid(boxes: DataFrame, cells: int = 8, scales: tuple[float, ...] = (1.0, 0.94, 1.06), nearest: int = NEAREST_BOXES) -> DataFrame:
    """(id, rank, x, y, side): crops around a square box (id, x, y, side, width, height) on a grid, nearest first.

    The grid has a third of a cell as its step and reaches 1.6 cells; crops beyond the picture are left out.
    """
    steps = F.explode(F.sequence(F.lit(-4), F.lit(4)))
    step = F.greatest(F.lit(3), F.floor(F.col("side") / cells / 3)).cast("int")
    grid = boxes.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).withColumn("i", steps).withColumn("j", steps)
    reach = 1.6 * F.col("side") / cells
    grid = grid.withColumns({"dx": F.col("i") * step, "dy": F.col("j") * step}).where((F.abs("dx") <= reach) & (F.abs("dy") <= reach))
    size = F.bround(F.col("side") * F.col("scale")).cast("int")
    grid = grid.withColumns({"nx": F.col("x") + F.col("dx"), "ny": F.col("y") + F.col("dy"), "ns": size})
    grid = grid.where((F.col("nx") >= 0) & (F.col("ny") >= 0) & (F.col("nx") + F.col("ns") <= F.col("width")) & (F.col("ny") + F.col("ns") <= F.col("height")))
    far = F.abs("dx") + F.abs("dy") + F.bround(F.abs(F.col("scale") - 1) * 100, 6)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(far, "nx", "ny", "ns"))
    return grid.withColumn("rank", rank).where(F.col("rank") <= nearest).select("id", "rank", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("ns").alias("side"))


def _signs_of_page(cx: np.ndarray, cy: np.ndarray, rank: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(box, sign) of a page in parts: the signs that lie in margins of their kind."""
    for kind, along, across, a0, a1, c0, c1 in ((True, cx, cy, x0, x1, y0, y1), (False, cy, cx, y0, y1, x0, x1)):
        own = np.flatnonzero(rank == kind)
        a, c = along[own], across[own]
        low, high = a0 + share * (a1 - a0), a1 - share * (a1 - a0)
        for near, far, is_first in ((a0, np.minimum(low, a1), True), (np.maximum(a0, high), a1, False)):
            for k, j in parts_of_strips(a, near, far, SWEPT_PAIRS):
                inside = a[j] < low[k] if is_first else (a[j] > high[k]) & (a[j] >= low[k])
                inside &= (c[j] >= c0[k]) & (c[j] <= c1[k])
                yield k[inside], own[j[inside]]


def _margin_signs(share: float):
    """Task function: batches of pages (page, signs, boxes) to rows of evidence, in batches of a bounded size however large the pages are."""

    def run(batches):
        found, held = [], 0
        for batch in batches:
            signs, boxes = batch.column("signs"), batch.column("boxes")
            s, b = signs.flatten(), boxes.flatten()
            sign = [s.field(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy")] + [s.field("rank").to_numpy(zero_copy_only=False).astype(bool)]
            edge = [b.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]
            s_at, b_at = (np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for x in (signs, boxes))

            def rows(found, batch=batch, s=s, b=b, sign=sign):
                page, box, at = (np.concatenate(x) for x in zip(*found, strict=True))
                axis, place = pc.if_else(pa.array(sign[2][at]), "rank", "file"), np.where(sign[2][at], sign[1][at], sign[0][at])
                columns = [batch.column("page").take(pa.array(page)), b.field("box").take(pa.array(box)), axis, pa.array(place, pa.float64()), s.field("value").take(pa.array(at))]
                return pa.RecordBatch.from_arrays(columns, ["page", "box", "axis", "position", "value"])

            for i in range(batch.num_rows):
                for k, j in _signs_of_page(*[x[s_at[i] : s_at[i + 1]] for x in sign], *[x[b_at[i] : b_at[i + 1]] for x in edge], share):
                    found.append((np.full(len(k), i), b_at[i] + k, s_at[i] + j))
                    held += len(k)
                    if held >= SWEPT_PAIRS:
                        yield rows(found)
                        found, held = [], 0
            if found:
                yield rows(found)
                found, held = [], 0

    return run


def _signs_and_boxes(pieces: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, signs, boxes): the single characters of a page that may be coordinates, and its boxes, as one row."""
    sign = F.lower(F.trim("text"))
    value = F.when(sign.rlike("^[1-8]$"), sign.cast("int")).when(sign.rlike("^[a-h]$"), F.ascii(sign) - F.lit(97))
    place = F.struct(F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), sign.rlike("^[1-8]$").alias("rank"), value.cast("int").alias("value"))
    signs = pieces.where(sign.rlike("^[1-8a-h]$") & F.col("cx").isNotNull() & F.col("cy").isNotNull()).groupBy("page").agg(F.collect_list(place).alias("signs"))
    edges = [F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    whole = F.col("bbox.x0").isNotNull() & F.col("bbox.y0").isNotNull() & F.col("bbox.x1").isNotNull() & F.col("bbox.y1").isNotNull()
    framed = boxes.where(whole).groupBy("page").agg(F.collect_list(F.struct("box", *edges)).alias("boxes"))
    return signs.join(framed, "page").select("page", "signs", "boxes")


def _margin_sums(share: float):
    """Task function: pages (page, signs, boxes) to a row for each box, with the moments of the signs in its margins by axis."""

    def run(batches):
        for batch in batches:
            signs, boxes = batch.column("signs"), batch.column("boxes")
            s, b = signs.flatten(), boxes.flatten()
            cx, cy, rank, value = (s.field(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy", "rank", "value"))
            x0, y0, x1, y1 = (b.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
            s_at, b_at = (np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for x in (signs, boxes))
            for i in range(batch.num_rows):
                own, held = slice(s_at[i], s_at[i + 1]), slice(b_at[i], b_at[i + 1])
                is_rank, edges = rank[own].astype(bool), (x0[held], x1[held], y0[held], y1[held])
                sums = [_moments(*[v[own][is_rank] for v in (cx, cy, value)], *edges, share), _moments(*[v[own][~is_rank] for v in (cy, cx, value)], *edges[2:], *edges[:2], share)]
                columns = [pa.array(x) for x in np.concatenate(sums, axis=1).T]
                page = batch.column("page").take(pa.array(np.full(held.stop - held.start, i)))
                yield pa.RecordBatch.from_arrays([page, b.field("box").slice(held.start, held.stop - held.start), *columns], ["page", "box", *_MOMENTS])

    return run


_MOMENTS = [f"{axis}_{name}" for axis in ("rank", "file") for name in ("n", "p", "v", "pp", "vv", "pv")]


def _moments(a: np.ndarray, c: np.ndarray, value: np.ndarray, a0: np.ndarray, a1: np.ndarray, c0: np.ndarray, c1: np.ndarray, share: float) -> np.ndarray:
    """[box, moment] the number of signs in the two margins across `a`, and the sums of p, v, p * p, v * v, p * v, p their place along the margin
    from the middle of the page's places and v their value.  The margins are those of `_signs_of_page`."""
    order = np.argsort(a, kind="stable")
    a, c, v = a[order], c[order], value[order].astype(float)
    p = c - (np.rint(np.nanmedian(c)) if len(c) else 0)
    weights = np.stack([np.ones(len(a)), p, v, p * p, v * v, p * v], axis=1)
    along, by_c = lambda at, side: np.searchsorted(a, at, side), np.sort(c)
    low, high = a0 + share * (a1 - a0), a1 - share * (a1 - a0)
    begin, end = along(a0, "left"), along(a1, "right")
    first = begin, np.minimum(end, along(low, "left"))
    second = np.maximum(np.maximum(begin, along(high, "right")), along(low, "left")), end
    bottom, top = np.searchsorted(by_c, c0, "left"), np.searchsorted(by_c, c1, "right")
    odd = np.isnan(a0) | np.isnan(a1) | np.isnan(c0) | np.isnan(c1)
    top = np.where(odd, bottom, np.maximum(bottom, top))
    return sum(sums_in_ranges(c, weights, f, np.maximum(f, e), bottom, top) for f, e in (first, second))


def coordinate_evidence(pieces: DataFrame, boxes: DataFrame, share: float = MARGIN_SHARE) -> DataFrame:
    """(page, box, axis, position, value): single characters in a diagram's margins that may be its printed coordinates.

    Of pieces (page, line, cx, cy, text), digits 1-8 near the left or right edge are ranks, by height; letters a-h near the top or
    bottom edge are files, from left to right.  The signs and the boxes of a page are one row; each margin finds its signs in their order
    across it, so a page costs n log n steps and those its narrow strips hold.  Places and boxes that are null, and pages without either, give no rows.
    """
    name = lambda c: boxes.schema[c].dataType.simpleString()
    pages = _signs_and_boxes(pieces, boxes)
    return pages.mapInArrow(_margin_signs(share), f"page {pages.schema['page'].dataType.simpleString()}, box {name('box')}, axis string, position double, value int")


def printed_orientation(pieces: DataFrame, boxes: DataFrame, share: float = MARGIN_SHARE) -> DataFrame:
    """(page, box, flipped): whether Black is at the bottom by the printed coordinates; null where these are few or disagree.

    With White below, ranks shrink downwards and files grow to the right.  The signs of a page are summed for all its boxes at once, so the work
    grows with n log n and not with the pairs of `coordinate_evidence`.
    """
    kind = lambda c: boxes.schema[c].dataType.simpleString()
    shape = ", ".join([f"page {kind('page')}", f"box {kind('box')}", *[f"{m} double" for m in _MOMENTS]])
    sums = _signs_and_boxes(pieces, boxes).mapInArrow(_margin_sums(share), shape).groupBy("page", "box").agg(*[F.sum(m).alias(m) for m in _MOMENTS])

    def trend(axis: str) -> Column:
        """1 if values grow along the margin, -1 if they shrink, null without a clear trend."""
        n, p, v, pp, vv, pv = (F.col(f"{axis}_{m}") for m in ("n", "p", "v", "pp", "vv", "pv"))
        spread = lambda one, two: F.when(n * two - one * one > NO_SPREAD * n * two, n * two - one * one)
        r = (n * pv - p * v) / F.sqrt(spread(p, pp)) / F.sqrt(spread(v, vv))
        return F.when((n >= TREND_POINTS) & (F.abs(r) >= TREND_LEAST), F.signum(r))

    ranks, files = trend("rank") == 1, trend("file") == -1
    agreed = F.when(F.coalesce(ranks == files, F.lit(True)), F.coalesce(ranks, files))
    return boxes.select("page", "box").join(sums.select("page", "box", agreed.alias("flipped")), ["page", "box"], "left")


def orphan_moves(lines: DataFrame, boxes: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """(page, line): lines (page, line, bbox, cx, cy, has_moves) with moves whose centre no box of the page holds.

    In order, each such line becomes a block of its own and then holds the centres of later lines too.  The lines without
    a box of one page are gathered in one row.
    """
    free = lines_outside(lines.where("has_moves"), boxes, tolerance)
    pages = free.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line", "cx", "cy", G.box(*[F.bround(f"bbox.{k}") for k in ("x0", "y0", "x1", "y1")]).alias("bbox")))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: G.holds(k["bbox"], x["cx"], x["cy"], tolerance)), kept).otherwise(F.concat(kept, F.array(x)))
    return pages.select("page", F.explode(F.aggregate("all", none, step)).alias("x")).select("page", "x.line")


def printed_pictures(images: DataFrame) -> DataFrame:
    """Numbered figures of pages (page, x, y, width, height, page_area, pixels): no full-page scans, repeated boxes once, at most 60 a page.

    They go from top to bottom in steps of 100, then left to right.  `extracted`: whether the picture is small enough to be read itself
    rather than cut from the page; the largest of repeated boxes decides.
    """
    box = ("page", "x", "y", "width", "height")
    kept = images.where(F.col("width") * F.col("height") < FULL_PAGE_SHARE * F.col("page_area")).groupBy(*box).agg(F.max("pixels").alias("pixels"))
    number = F.row_number().over(Window.partitionBy("page").orderBy(F.bround(F.col("y") / 100), "x", "y", "width", "height"))
    return kept.withColumn("number", number).where(F.col("number") <= MAX_IMAGES).withColumn("extracted", F.col("pixels").between(1, MAX_IMAGE_PIXELS))
