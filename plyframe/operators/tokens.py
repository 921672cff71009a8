"""Move notation of pages as a token table (page, idx, kind, value, start, end), and the structure of variations on it.

Tokens and their offsets come from one regular expression: the text is split at its matches, and running lengths of parts
and matches give the places.  Brackets, runs and plies are windows over the tokens of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PIECES, STRAY_REACH
from ..functions import text as T

# The forms of printed moves, numbers and results.
_NUMBER = r"(?<![a-h])\d+(?:\.\.\.|\.(?!\.))"
_CASTLING = r"0-0-0|0-0|O-O-O|O-O"
RESULTS = ("1-0", "0-1", "1/2-1/2")
#: What may stand right after a move: the end, a sign, a draw sign, or the next number, square, castling or capitalised word.
_FOLLOWS = "(?=" + "|".join((r"\z", r"[^A-Za-z0-9.=]", r"=(?![A-Za-z0-9])", r"\d+\.", r"[a-h][1-8]", r"0-0", r"O-O", r"[A-Z]['’]?[a-zé]")) + ")"


def token_pattern(lang: str) -> str:
    """Numbers, moves, `;`, brackets and results of a language's notation, as one alternation without groups."""
    p = PIECES[lang]
    move = rf"(?:{_CASTLING}|[{p}]?[a-h]?[1-8]?x?[a-h][1-8](?:=[{p[:4]}]|(?<=[18])[{p[:4]}])?)[+#]?[!?]*"
    return rf"{_NUMBER}|{move}{_FOLLOWS}|;|[\[(]|[\])]|{'|'.join(RESULTS)}"


def _kind(value: Column) -> Column:
    return (
        F.when(value == ";", "semi").when(value.isin("(", "["), "open").when(value.isin(")", "]"), "close").when(value.isin(*RESULTS), "res")
        .when(value.rlike(r"^\d+\.+$"), "num").otherwise("move")
    )


def tokens(pages: DataFrame, lang: str = "fr") -> DataFrame:
    """(page, idx, kind, value, start, end) of (page, text).

    Prose between two tokens is a token too.  A `)` after a single letter, with no `(` open, labels an alternative: it is
    no token, or a `;` after a comma.
    """
    pattern = token_pattern(lang)
    parts, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), 0)
    raw = pages.select("page", "text", F.posexplode(F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("before"), found.alias("value"))).alias("seq", "t")).select("page", "text", "seq", "t.*")
    upto = Window.partitionBy("page").orderBy("seq")
    raw = raw.withColumn("end", F.sum(F.length("before") + F.length("value")).over(upto).cast("int")).withColumn("start", (F.col("end") - F.length("value")).cast("int"))
    step = F.when(F.col("value") == "(", 1).when(F.col("value") == ")", -1).otherwise(0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    raw = raw.withColumn("level", F.coalesce(F.sum(step).over(before), F.lit(0)))
    raw = raw.withColumn("open", F.col("level") - F.least(F.lit(0), F.coalesce(F.min("level").over(upto), F.lit(0))))
    letter = F.substring("text", F.greatest(F.col("start") - 1, F.lit(1)), F.least(F.col("start"), F.lit(2))).rlike(r"(?<![\w.])[A-Za-z]$")
    label = (F.col("value") == ")") & (F.col("open") == 0) & letter
    comma = F.rtrim(F.substring("text", F.lit(1), F.greatest(F.col("start") - 1, F.lit(0)))).endswith(",")
    raw = raw.withColumns({"label": label, "kind": F.when(label & comma, F.lit("semi")).when(~label, _kind(F.col("value")))})
    raw = raw.withColumn("from", F.coalesce(F.last(F.when(~F.col("label"), F.col("end")), True).over(before), F.lit(0)))
    prose = F.expr("substring(text, `from` + 1, start - `from`)")
    prosaic = ~F.col("label") & (F.btrim(prose, F.lit(" \n\t,;:.()")) != "")
    real = F.when(F.col("kind").isNotNull(), F.struct("kind", F.when(F.col("label"), F.lit(";")).otherwise(F.col("value")).alias("value"), "start", "end"))
    said = F.when(prosaic, F.struct(F.lit("prose").alias("kind"), F.lit("").alias("value"), F.col("from").alias("start"), F.col("start").alias("end")))
    out = raw.select("page", "seq", F.posexplode(F.array_compact(F.array(said, real))).alias("part", "t"))
    idx = (F.row_number().over(Window.partitionBy("page").orderBy("seq", "part")) - 1).cast("int")
    return out.select("page", idx.alias("idx"), "t.kind", "t.value", "t.start", "t.end")


def with_next(toks: DataFrame) -> DataFrame:
    return toks.withColumn("next_kind", F.lead("kind").over(Window.partitionBy("page").orderBy("idx")))


def with_previous(toks: DataFrame, back: int = 3) -> DataFrame:
    """`before`: the `back` tokens before each one, the nearest first, as structs (kind, value); fewer at the beginning of a page."""
    w = Window.partitionBy("page").orderBy("idx")
    one = F.struct("kind", "value")
    return toks.withColumn("before", F.array_compact(F.array(*[F.lag(one, k).over(w) for k in range(1, back + 1)])))


def move_pairs(toks: DataFrame) -> DataFrame:
    """(page, pairs, starts): numbers followed by a move, and whether the page begins a game at move 1."""
    pair = (F.col("kind") == "num") & (F.col("next_kind") == "move")
    return with_next(toks).groupBy("page").agg(F.count_if(pair).alias("pairs"), F.coalesce(F.bool_or(pair & (F.col("value") == "1.")), F.lit(False)).alias("starts"))


def shown_spans(toks: DataFrame) -> DataFrame:
    """`shown_from`: where a move begins as printed, with the number that is glued to it."""
    w = Window.partitionBy("page").orderBy("idx")
    glued = (F.col("kind") == "move") & (F.lag("kind").over(w) == "num") & (F.lag("end").over(w) == F.col("start"))
    return toks.withColumn("shown_from", F.when(glued, F.lag("start").over(w)).otherwise(F.col("start")))


def with_runs(toks: DataFrame) -> DataFrame:
    """`run`: tokens between two prose tokens; `trusted`: a number stands in the run, up to here."""
    order = Window.partitionBy("page").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = toks.withColumn("run", F.sum((F.col("kind") == "prose").cast("int")).over(order).cast("int"))
    inside = Window.partitionBy("page", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("trusted", F.max((F.col("kind") == "num").cast("int")).over(inside) == 1)


def with_depth(toks: DataFrame) -> DataFrame:
    """`depth`: brackets open after a token, stray closing ones left out; `stray`: whether it closes nothing."""
    order = Window.partitionBy("page").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    out = toks.withColumn("level", F.sum(step).over(order)).withColumn("low", F.least(F.lit(0), F.min("level").over(order)))
    fell = F.col("low") < F.coalesce(F.lag("low").over(Window.partitionBy("page").orderBy("idx")), F.lit(0))
    return out.withColumns({"depth": (F.col("level") - F.col("low")).cast("int"), "stray": fell}).drop("level", "low")


def stray_close(toks: DataFrame, reach: int = STRAY_REACH) -> DataFrame:
    """(page, idx, early): the first stray bracket of a page, and the outermost bracket of its kind that closed before it, at most `reach` tokens away."""
    deep = with_depth(toks)
    order = Window.partitionBy("page", "value").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    outer = (F.col("kind") == "close") & (F.col("depth") == 0) & ~F.col("stray")
    seen = deep.withColumn("early", F.last(F.when(outer, F.col("idx")), True).over(order)).where("stray")
    first = seen.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("idx"))).where("rank = 1")
    return first.where(F.col("idx") - F.col("early") <= reach).select("page", "idx", "early")


def variations(toks: DataFrame) -> DataFrame:
    """(page, idx, value, depth, ply, parent, start): the moves as a tree.

    The ply follows from the last printed number before the move at its own depth; the parent is the move before it on
    its own line, or the move that its bracket varies.  All are windows over a page: its tokens are made and dealt once, and nothing is joined.
    """
    move = F.when(F.col("kind") == "move", F.col("idx"))
    upto = lambda *keys: Window.partitionBy("page", *keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # an opening bracket stands among the tokens around it, so the last move there is the one that it varies
    deep = with_depth(toks).withColumn("around", F.when(F.col("kind") == "open", F.col("depth") - 1).otherwise(F.col("depth")))
    seen = deep.withColumn("varied", F.last(move, True).over(upto("around")))
    bracket = F.last(F.when(F.col("kind") == "open", F.struct("idx", "varied")), True).over(upto("depth"))
    opened = seen.withColumn("bracket", F.when(F.col("depth") > 0, bracket)).withColumn("line", F.coalesce("bracket.idx", F.lit(-1)))
    on_line = upto("depth", "line")
    counted = opened.withColumns({"nth": F.sum((F.col("kind") == "move").cast("int")).over(on_line), "same": F.last(move, True).over(on_line.rowsBetween(Window.unboundedPreceding, -1))})
    number = F.when(F.col("kind") == "num", F.struct(T.ply_of(F.col("value")).alias("ply"), "nth"))
    moves = counted.withColumn("number", F.last(number, True).over(on_line)).where("kind = 'move'")
    ply = (F.col("number.ply") + F.col("nth") - F.col("number.nth") - 1).cast("int")
    return moves.select("page", "idx", "value", "depth", ply.alias("ply"), F.coalesce("same", "bracket.varied").alias("parent"), "start")


def start_candidates(firsts: DataFrame, moves: DataFrame) -> DataFrame:
    """(page, other, idx, away, rank): main-line moves of other pages after which a page's first printed ply comes next.

    `rank` is their order: the nearest page first, of pages equally far the earlier one, and in a page the first move.
    """
    main = moves.where("depth = 0").select(F.col("page").alias("other"), "idx", (F.col("ply") + 1).alias("ply"))
    joined = firsts.join(main, "ply").where(F.col("other") != F.col("page")).withColumn("away", F.abs(F.col("other") - F.col("page")))
    return joined.select("page", "other", "idx", "away", F.row_number().over(Window.partitionBy("page").orderBy("away", "other", "idx")).alias("rank"))
