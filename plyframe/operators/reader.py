"""What the reader of a book derives: visible flags, text slices, page steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HEAD_CHARS, PARAGRAPH_CHARS
from ..functions import boards as B
from ..functions import text as T


def pages_to_anchor(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """The pages (page, has_moves) with moves in the text of which none was read or some are illegal."""
    read = moves.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    joined = pages.where("has_moves").join(read, "page", "left")
    return joined.where((F.coalesce("n", F.lit(0)) == 0) | (F.col("bad") > 0)).select("page")


def flags(rows: DataFrame) -> DataFrame:
    """`clickable`, `side` and `paragraph` of diagrams with a caption (fen, side_known, text)."""
    side = F.when(F.col("side_known"), F.split("fen", " ")[1] == "w")
    return rows.withColumns({"clickable": F.col("fen").isNotNull(), "white_to_move": side, "paragraph": F.length("text") >= PARAGRAPH_CHARS})


def accepted_spans(spans: Column) -> Column:
    """Of spans (s, e) in order, those that begin at or after the end of the last one accepted."""
    kind = "array<struct<s: int, e: int>>"
    step = lambda acc, x: F.when(x["s"] >= F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(0)), F.concat(acc, F.array(x))).otherwise(acc).cast(kind)
    return F.aggregate(spans.cast(kind), F.array().cast(kind), step)


def slices(text: Column, spans: Column) -> Column:
    """The text cut at its accepted spans: array of (move, part), where plain parts may be empty."""
    kept = accepted_spans(spans)
    before = lambda x, i: F.substring(text, F.when(i == 0, 1).otherwise(F.get(kept, F.greatest(i - 1, F.lit(0)))["e"] + 1), x["s"] - F.when(i == 0, 0).otherwise(F.get(kept, F.greatest(i - 1, F.lit(0)))["e"]))
    pairs = F.flatten(F.transform(kept, lambda x, i: F.array(F.struct(F.lit(False).alias("move"), before(x, i).alias("part")), F.struct(F.lit(True).alias("move"), F.substring(text, x["s"] + 1, x["e"] - x["s"]).alias("part")))))
    tail = F.substring(text, F.coalesce(F.get(kept, F.size(kept) - 1)["e"], F.lit(0)) + 1, F.length(text))
    return F.concat(pairs, F.array(F.struct(F.lit(False).alias("move"), tail.alias("part"))))


def page_steps(pages: DataFrame) -> DataFrame:
    """(book, page, previous, next) of the pages a book has; the ends step to themselves."""
    w = Window.partitionBy("book").orderBy("page")
    distinct = pages.select("book", "page").distinct()
    return distinct.withColumns({"previous": F.coalesce(F.lag("page").over(w), F.col("page")), "next": F.coalesce(F.lead("page").over(w), F.col("page"))})


def fit_zoom(width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    """Percent at which a page fits a view, between 10 and 400."""
    return F.greatest(F.lit(10.0), F.least(F.lit(400.0), F.least(view_width / width, view_height / height) * 100))


def next_main_move(moves: DataFrame) -> DataFrame:
    """`next_main`: idx of the next move of the main line after each move."""
    after = Window.partitionBy("page").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    return moves.withColumn("next_main", F.first(F.when(F.col("depth") == 0, F.col("idx")), True).over(after))


def said_before(moves: DataFrame, reach: int = 8) -> DataFrame:
    """`repeated`: whether one of the last `reach` moves of the page has the same text."""
    back = Window.partitionBy("page").orderBy("idx").rowsBetween(-reach, -1)
    return moves.withColumn("repeated", F.array_contains(F.collect_list("value").over(back), F.col("value")))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order): distinct values with the place where each is first seen."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def heads_cut(blocks: DataFrame, window: int = HEAD_CHARS) -> DataFrame:
    """(page, ord, text, cut) of blocks (page, ord, text, reread), cut where they repeat the head of a block that was read again.

    Blocks that came out empty are read again, in order (`reread`); a head is their first `window` characters, or all there are.  A block is cut
    before the first occurrence of such a head unless the block begins with it.  A block that is itself read again is empty until then, so
    only heads of later ones count for it.  Blanks at the end of a cut block go.
    """
    heads = blocks.where("reread and text <> ''").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", F.substring("text", 1, window).alias("head")))).alias("heads"))
    joined = blocks.join(heads, "page", "left")
    others = F.filter(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), lambda h: (h["ord"] != F.col("ord")) & (~F.col("reread") | (h["ord"] > F.col("ord"))))
    step = lambda text, h: F.when(F.position(h["head"], text) > 1, F.regexp_replace(F.substring(text, F.lit(1), F.position(h["head"], text) - 1), r"\s+$", "")).otherwise(text)
    after = F.aggregate(others, F.col("text"), step)
    return joined.select("page", "ord", after.alias("text"), (F.length(after) < F.length("text")).alias("cut"))


def zipped(left: Column, right: Column) -> Column:
    """Pairs (left, right) of two arrays by place, as many as the shorter one has."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def picked(cells: DataFrame, picks: DataFrame) -> DataFrame:
    """Cells with the letter a person gave to their page and text; cells without one are left out."""
    return cells.join(picks, ["page", "text"])


def labelled(diagrams: DataFrame, hand: DataFrame) -> DataFrame:
    """Diagrams (book, id, matches, fen, flipped) with a position from a game or by hand, the hand label first.

    `fen` is the placement as printed: turned by half where Black is at the bottom of the picture.
    """
    joined = diagrams.join(hand.withColumnRenamed("fen", "by_hand"), ["book", "id"], "left")
    used = joined.where(F.col("matches").isNotNull() | F.col("by_hand").isNotNull())
    cells = B.squares(F.split(F.coalesce("by_hand", "fen"), " ")[0])
    return used.select("book", "id", B.placement(F.when(F.col("flipped"), B.rotated(cells)).otherwise(cells)).alias("fen"))
