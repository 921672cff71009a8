"""Column functions over positions: a placement is the first field of a FEN, `squares` its 64 characters from a8 to h1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import KING_GAIN, SQUARE_CLASSES, SURE_RANKS


def squares(placement: Column) -> Column:
    text = F.replace(placement, F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit(str(n)), F.lit("." * n))
    return text


def placement(cells: Column) -> Column:
    """The placement of 64 characters."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.substring(cells, r * 8 + 1, F.lit(8)))
    text = F.array_join(rows, "/")
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit("." * n), F.lit(str(n)))
    return text


def from_classes(classes: Column) -> Column:
    """64 characters from an array of classes 0-12 (empty, white PNBRQK, black)."""
    return F.array_join(F.transform(classes, lambda c: F.substring(F.lit(SQUARE_CLASSES), c + 1, F.lit(1))), "")


def rotated(cells: Column) -> Column:
    return F.reverse(cells)


def _mean_rank(cells: Column, pieces: str) -> Column:
    """Mean rank (0 at the bottom) of some pieces; 0 if there are none."""
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.substring(cells, i + 1, F.lit(1)).rlike(f"[{pieces}]"), F.lit(7) - F.floor(i / 8)))
    found = F.array_compact(at)
    return F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(found), F.lit(1))


def white_bottom_score(cells: Column) -> Column:
    """Above 0 if White looks at the bottom: the gap of the armies' mean ranks."""
    return _mean_rank(cells, "pnbrqk") - _mean_rank(cells, "PNBRQK")


def oriented(cells: Column, flip: Column | None = None) -> Column:
    """struct(cells, flipped, sure): turned if Black is at the bottom, by printed coordinates where these are known."""
    score = white_bottom_score(cells)
    known = F.lit(None).cast("boolean") if flip is None else flip
    flipped = F.coalesce(known, score < 0)
    sure = known.isNotNull() | (F.abs(score) >= SURE_RANKS)
    return F.struct(F.when(flipped, rotated(cells)).otherwise(cells).alias("cells"), flipped.alias("flipped"), sure.alias("sure"))


def colours_only_differ(a: Column, b: Column) -> Column:
    return (a != b) & (F.lower(a) == F.lower(b))


def distance(a: Column, b: Column) -> Column:
    """Squares on which two boards differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def errors(read: Column, truth: Column) -> Column:
    """struct(ghost, missing, wrong): pieces read on empty squares, not read, and misread."""
    pairs = F.arrays_zip(F.split(read, "").alias("r"), F.split(truth, "").alias("t"))
    n = lambda test: F.size(F.filter(pairs, test))
    return F.struct(
        n(lambda p: (p["t"] == ".") & (p["r"] != ".")).alias("ghost"), n(lambda p: (p["t"] != ".") & (p["r"] == ".")).alias("missing"),
        n(lambda p: (p["t"] != ".") & (p["r"] != ".") & (p["t"] != p["r"])).alias("wrong"),
    )


def count_of(cells: Column, letter: str) -> Column:
    return F.length(cells) - F.length(F.replace(cells, F.lit(letter), F.lit("")))


def issues(cells: Column) -> Column:
    """Names of what cannot be in a game's position whoever moves: kings, pawns, back ranks, promotions."""
    n = lambda letter: count_of(cells, letter)
    checks = []
    for colour, case in (("white", str.upper), ("black", str.lower)):
        total = sum((n(case(p)) for p in "nbrqk"), n(case("p")))
        extra = sum((F.greatest(n(case(p)) - k, F.lit(0)) for p, k in (("r", 2), ("b", 2), ("n", 2))), F.greatest(n(case("q")) - 1, F.lit(0)))
        checks += [
            (f"no_{colour}_king", n(case("k")) == 0), (f"too_many_{colour}_pawns", n(case("p")) > 8), (f"too_many_{colour}_pieces", total > 16),
            (f"too_many_{colour}_pieces_for_pawns", n(case("p")) + extra > 8),
        ]
    edge = F.concat(F.substring(cells, 1, 8), F.substring(cells, 57, 8))
    checks += [("too_many_kings", (n("K") > 1) | (n("k") > 1)), ("pawns_on_backrank", edge.rlike("[Pp]")), ("empty", ~cells.rlike("[A-Za-z]"))]
    return F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks])))


def swap_kings(cells: Column) -> Column:
    return F.translate(cells, "Kk", "kK")


def repaired_kings(cells: Column) -> Column:
    """Kings of swapped colours are exchanged when both stand clearly nearer to the other army's pawns."""
    one = (count_of(cells, "K") == 1) & (count_of(cells, "k") == 1) & cells.contains("P") & cells.contains("p")
    rank = lambda letter: F.lit(7) - F.floor((F.instr(F.translate(cells, "Kk", letter), "!") - 1) / 8)
    white, black = rank("!k"), rank("K!")
    own, other = _mean_rank(cells, "P"), _mean_rank(cells, "p")
    gain_w = F.abs(white - own) - F.abs(white - other)
    gain_b = F.abs(black - other) - F.abs(black - own)
    better = one & (gain_w > 0) & (gain_b > 0) & (gain_w + gain_b >= KING_GAIN) & (F.size(issues(swap_kings(cells))) == 0)
    return F.when(better, swap_kings(cells)).otherwise(cells)


def side_of_dot(centre_share: Column, flipped: Column) -> Column:
    """The side to move from a dot's height on the page beside the board (0 top, 1 bottom)."""
    return F.when((centre_share < 0.5) == flipped, F.lit("w")).otherwise(F.lit("b"))


def confidence(probabilities: Column) -> Column:
    """Mean of the highest probability of each square, to three places, half to even."""
    best = F.transform(probabilities, F.array_max)
    return F.bround(F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / F.size(best), 3)
