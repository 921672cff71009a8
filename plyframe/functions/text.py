"""Column functions over text, notation and messages."""

from __future__ import annotations

from html import unescape as html_unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PIECES

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def squash(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def non_blank(text: Column) -> Column:
    return text.rlike(r"\S")


def n_words(text: Column) -> Column:
    """Words of a text; an empty text has none."""
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def unescaped(text: Column) -> Column:
    """All HTML entities decoded, in Arrow batches; `plain_html` knows the common ones without Python."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(html_unescape, na_action="ignore")

    return run(text)


def plain_html(html: Column) -> Column:
    """Markup to text: tags become blanks, entities are decoded, blanks are single."""
    text = F.regexp_replace(html, r"<[^>]+>", " ")
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def to_san(move: Column, lang: str) -> Column:
    """A printed move in English letters; castling by letters O, annotations dropped."""
    castled = F.replace(F.replace(move, F.lit("0-0-0"), F.lit("O-O-O")), F.lit("0-0"), F.lit("O-O"))
    head = F.rtrim(castled, F.lit("!?"))
    return F.when(head.contains("O"), head).otherwise(F.translate(head, PIECES[lang], PIECES["en"]))


def plausible_lone(move: Column, lang: str) -> Column:
    """Whether a move without a number looks like one: capture, piece, castling, annotation or promotion."""
    pieces = PIECES[lang]
    return move.contains("x") | move.rlike(f"^[{pieces}]") | move.rlike("^(0-0|O-O)") | move.rlike("[!?]$") | move.contains("=") | move.rlike(f"[18][{pieces[:4]}]")


def edit_class(a: Column, b: Column) -> Column:
    """0 if equal, 1 if b has one more character, 2 if one is replaced, else null."""
    one = F.levenshtein(a, b) == 1
    return F.when(a == b, 0).when(one & (F.length(b) == F.length(a) + 1), 1).when(one & (F.length(b) == F.length(a)), 2)


def cache_key(content: Column, version: str) -> Column:
    """The key of what a version of the code makes of some content."""
    return F.concat(F.lit(f"{version}_"), F.sha2(content, 256))


def mmss(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def ply_of(number: Column) -> Column:
    """The ply of a printed move number: `12.` is White's, `12...` Black's."""
    full = F.regexp_extract(number, r"(\d+)", 1).cast("int")
    return full * 2 - F.when(number.endswith("..."), 1).otherwise(2)


def move_label(fen: Column, san: Column) -> Column:
    """`3. Nf3` or `2... d5` from the position after the move."""
    part = F.split(fen, " ")
    full, white_next = part[5].cast("int"), part[1] == "w"
    return F.when(white_next, F.concat((full - 1).cast("string"), F.lit("... "), san)).otherwise(F.concat(full.cast("string"), F.lit(". "), san))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def with_side(fen: Column, side: Column, keep_rights: Column) -> Column:
    """A FEN with the side set and counters reset; castling and en passant kept only where asked."""
    part = F.split(fen, " ")
    rights = F.when(keep_rights, F.concat_ws(" ", part[2], part[3])).otherwise(F.lit("- -"))
    return F.concat_ws(" ", part[0], side, rights, F.lit("0 1"))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def row_id(prefix: str, page: Column, kind: str, number: Column) -> Column:
    """Ids such as p3_t7."""
    return F.concat(F.lit(prefix), page.cast("string"), F.lit(f"_{kind}"), number.cast("string"))


def member_name(folder: str, page: Column, suffix: str) -> Column:
    """The member of a page, its number in four digits or, from 10000 on, in as many as it has."""
    number = page.cast("string")
    return F.concat(F.lit(f"{folder}/p"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")), F.lit(suffix))


def plural(n: Column, lang: Column, one: Column, other: Column) -> Column:
    """French counts 0 as singular, English and Spanish do not."""
    return F.when((lang == "fr") & (n < 2), one).when(n == 1, one).otherwise(other)


def language(setting: Column, system: Column, known: tuple[str, ...]) -> Column:
    """The setting, else the first known language of the system's list, else English."""
    codes = F.transform(system, lambda x: F.lower(F.substring(x, 1, 2)))
    first = F.get(F.filter(codes, lambda x: x.isin(*known)), F.lit(0))
    return F.coalesce(F.when(setting.isin(*known), setting), first, F.lit("en"))


def fill_garbage(text: Column, letters: Column) -> Column:
    """Each run of non-ASCII signs is replaced by the next letter, if there are as many letters as runs."""
    parts = F.split(text, r"\P{ASCII}+")
    runs = F.size(parts) - 1
    joined = F.array_join(F.transform(F.arrays_zip(parts.alias("part"), letters.alias("letter")), lambda x: F.concat(x["part"], F.coalesce(x["letter"], F.lit("")))), "")
    return F.when(runs == F.size(letters), joined).otherwise(text)


def san_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-h1-8xNBRQKO0=+#-]", "")


def table_cells(html: Column) -> Column:
    """Cells of each row of a table without the first, and without those of dots: array of arrays."""
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"<td[^>]*>(.*?)</td>"), 1)
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)
    return F.transform(rows, lambda r: F.filter(F.slice(cells(r), 2, F.greatest(F.size(cells(r)), F.lit(1))), lambda c: F.trim(c) != "..."))


def file_stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*\z", 1), r"(?s)\A(.+)\.[^.]+\z", "$1")


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])
