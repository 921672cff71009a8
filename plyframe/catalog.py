"""The queries of the library and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plans.flow import book_report

MODULES = ("flow", "block_queries", "board_queries", "table_queries", "reader_queries", "page_queries", "archive_queries", "picture_queries")
FLAGSHIP = book_report


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found = {}
    for name in MODULES:
        found |= import_module(f".plans.{name}", __package__).QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
