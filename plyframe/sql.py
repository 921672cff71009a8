"""Table functions for SQL: the tokens and the moves of a text, for use with LATERAL.

They are the plans of `operators.tokens` for one text, without Python:

    SELECT doc_id, t.* FROM documents, LATERAL book_tokens_en(text) AS t

Windows run over the tokens of each row.  A null text has no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .constants import PIECES
from .operators.tokens import RESULTS, token_pattern

_TOKENS = """
SELECT CAST(row_number() OVER (ORDER BY seq, part) - 1 AS INT), p.kind, p.value, p.start, p.end FROM (
  SELECT seq, posexplode(array_compact(array(
    CASE WHEN NOT label AND btrim(substring(t, said_from + 1, begin - said_from), ' \\n\\t,;:.()') <> '' THEN named_struct('kind', 'prose', 'value', '', 'start', said_from, 'end', begin) END,
    CASE WHEN kind IS NOT NULL THEN named_struct('kind', kind, 'value', CASE WHEN label THEN ';' ELSE v END, 'start', begin, 'end', stop) END))) AS (part, p)
  FROM (
    SELECT *, coalesce(last(CASE WHEN NOT label THEN stop END, true) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS said_from,
      CASE WHEN label AND endswith(rtrim(substring(t, 1, greatest(begin - 1, 0))), ',') THEN 'semi' WHEN label THEN NULL
           WHEN v = ';' THEN 'semi' WHEN v IN ('(', '[') THEN 'open' WHEN v IN (')', ']') THEN 'close' WHEN v IN ({results}) THEN 'res' WHEN v RLIKE r"^\\d+\\.+$" THEN 'num' ELSE 'move' END AS kind
    FROM (
      SELECT *, v = ')' AND level - least(0, coalesce(min(level) OVER (ORDER BY seq), 0)) = 0 AND substring(t, greatest(begin - 1, 1), least(begin, 2)) RLIKE r"(?<![\\w.])[A-Za-z]$" AS label
      FROM (
        SELECT *, CAST(stop - length(v) AS INT) AS begin, coalesce(sum(CASE v WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level
        FROM (
          SELECT t, seq, z.v AS v, CAST(sum(length(z.b) + length(z.v)) OVER (ORDER BY seq) AS INT) AS stop
          FROM (SELECT text AS t, posexplode(zip_with(split(text, {pattern}, -1), regexp_extract_all(text, {pattern}, 0), (b, v) -> named_struct('b', b, 'v', v))) AS (seq, z)) WHERE z.v IS NOT NULL)))))
"""

_MOVES = """
SELECT kind, idx, value, depth, CAST(ply_of_number + nth - min(CASE WHEN kind = 'move' THEN nth END) OVER (PARTITION BY depth, line, number_at) AS INT) AS ply, start, end FROM (
  SELECT *, last(CASE WHEN kind = 'num' THEN idx END, true) OVER w AS number_at, sum(CASE WHEN kind = 'move' THEN 1 ELSE 0 END) OVER w AS nth,
    last(CASE WHEN kind = 'num' THEN CAST(regexp_extract(value, r"(\\d+)", 1) AS INT) * 2 - CASE WHEN endswith(value, '...') THEN 1 ELSE 2 END END, true) OVER w AS ply_of_number
  FROM (
    SELECT *, CASE WHEN depth > 0 THEN last(CASE WHEN kind = 'open' THEN idx END, true) OVER (PARTITION BY depth ORDER BY idx) ELSE -1 END AS line
    FROM (
      SELECT *, CAST(level - least(0, min(level) OVER (ORDER BY idx)) AS INT) AS depth
      FROM (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (ORDER BY idx) AS level FROM {tokens}(text))))
  WINDOW w AS (PARTITION BY depth, line ORDER BY idx))
"""


def register(spark: SparkSession) -> None:
    """Makes `book_tokens_<lang>(text)` (idx, kind, value, start, end) and `book_moves_<lang>(text)` (idx, value, depth, ply, start, end) known to a session."""
    results = ", ".join(f"'{r}'" for r in RESULTS)
    for lang in PIECES:
        tokens = _TOKENS.format(pattern=f'r"{token_pattern(lang)}"', results=results)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION book_tokens_{lang}(text STRING) RETURNS TABLE (idx INT, kind STRING, value STRING, start INT, end INT) RETURN {tokens}")
        moves = _MOVES.format(tokens=f"book_tokens_{lang}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION book_moves_{lang}(text STRING) RETURNS TABLE (idx INT, value STRING, depth INT, ply INT, start INT, end INT) RETURN SELECT idx, value, depth, ply, start, end FROM ({moves}) WHERE kind = 'move'")
