"""Column functions over boxes; a box is a struct (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import RECT_WIDEN


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def holds(b: Column, x: Column, y: Column, tolerance: float = 0) -> Column:
    """Whether a point lies in the box widened by the tolerance."""
    return (x >= b["x0"] - tolerance) & (x <= b["x1"] + tolerance) & (y >= b["y0"] - tolerance) & (y <= b["y1"] + tolerance)


def shares_width(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"])


def padded(b: Column, pad: float) -> Column:
    return box(b["x0"] - pad, b["y0"] - pad, b["x1"] + pad, b["y1"] + pad)


def scaled(b: Column, factor: float) -> Column:
    """Rounded half to even, as from points to pixels."""
    return box(*[F.bround(b[k] * factor).cast("int") for k in ("x0", "y0", "x1", "y1")])


def xywh(b: Column) -> Column:
    return F.array(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])


def character_boxes(text: Column, b: Column) -> Column:
    """The box of a piece of text shared evenly among its characters."""
    width, n = b["x1"] - b["x0"], F.length(text)
    one = lambda i: box(b["x0"] + width * i / n, b["y0"], b["x0"] + width * (i + 1) / n, b["y1"])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))


def widened(b: Column) -> Column:
    """A little wider on both sides, in proportion to the height."""
    by = (b["y1"] - b["y0"]) * RECT_WIDEN
    return box(b["x0"] - by, b["y0"], b["x1"] + by, b["y1"])


def zoom_presets(now: Column, presets: Column) -> tuple[Column, Column]:
    """(next, previous) preset more than half a percent away; the last, the first, if there is none."""
    up = F.array_min(F.filter(presets, lambda p: p > now + 0.5))
    down = F.array_max(F.filter(presets, lambda p: p < now - 0.5))
    return F.coalesce(up, F.array_max(presets)), F.coalesce(down, F.array_min(presets))
