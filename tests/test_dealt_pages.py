"""Queries whose orders are dealt to 500 pages: what lies on one page meets, however far apart its orders are."""

import pytest

from plyframe import catalog
from tests.against import rows_of, rows_of_sql

#: Key, customer: on page 1 the boxes 1, 1001 and 501 lie below each other, in this order; box 2 is alone on its page.
ORDERS = [(1, 10), (501, 10), (1001, 10), (2, 300)]
#: Key, part, supplier, number: the signs d, f and h from left to right in the top margin of box 1, and 5 on page 2.
LINES = [(1, 40, 2997, 1), (501, 60, 2997, 1), (1001, 80, 2997, 1), (2, 50, 2997, 1)]

WANT = {
    "line_in_box_join": {(1, 11, 1), (1, 5011, 1), (1, 10011, 1)},
    "orphan_lines": {(2, 21)},
    "next_block_below": {(1, 1, 1001), (1, 1001, 501), (1, 501, None), (2, 2, None)},
    "layout_obstacles": {(1, 1, 200.0), (1, 1001, 1300.0), (1, 501, None), (2, 2, None)},
    "coordinate_evidence": {(1, 1, "file", 40.0, 3), (1, 1, "file", 60.0, 5), (1, 1, "file", 80.0, 7)},
    "printed_orientation": {(1, 1, False), (1, 501, None), (1, 1001, None), (2, 2, None)},
}


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dealt"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", WANT)
def test_orders_of_a_page_meet(spark, dealt, name):
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{dealt}/{table}.parquet/*.parquet'")
    rows = catalog.queries()[name](spark, dealt)
    assert set(map(tuple, rows.collect())) == WANT[name]
    assert rows_of(rows) == rows_of_sql(con, catalog.oracle_sql()[name])
