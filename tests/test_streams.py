"""States of runs as a stream, the sink of protocol lines, and the store of results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plyframe.sources import cache
from plyframe.streaming import progress, runs

STEPS = ("read", "move", "draw")
BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SHAPE = "run string, at timestamp, label string, code int"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def at(seconds):
    return BEGIN + dt.timedelta(seconds=seconds)


def test_runs_as_a_stream_equal_the_batch(rocks, tmp_path):
    """Rows out of order, over two calls that share a checkpoint; one run falls silent and goes on, one ends, one is only named."""
    batches = [
        [("a", at(5), "move", None), ("a", at(0), "read", None), ("b", at(0), "read", None), ("c", at(1), "none", None)],
        [("a", at(60), None, 0), ("a", at(30), "draw", None), ("d", at(70), "read", None)],
        [("e", at(2000), "read", None)],
        [("e", at(2100), None, None)],
        [("b", at(2200), "draw", None), ("d", at(2150), None, 3)],
    ]
    seen = []

    def keep(batch, number):
        seen.extend((r.run, r.stage, r.steps, r.clock, r.state, r.code) for r in batch.collect())

    def call(n):
        for i, rows in enumerate(batches[:n]):
            folder = tmp_path / f"in/{i}"
            if not folder.exists():
                rocks.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(folder))
        stream = rocks.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = runs.states(stream, STEPS, 600, "60 seconds").writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    call(2)
    assert {s[0]: s for s in seen}["a"] == ("a", 3, 3, "01:00", "done", 0)
    call(5)
    assert ("b", 1, 3, "00:00", "stalled", None) in seen and ("a", 3, 3, "01:00", "stalled", 0) not in seen
    last = {s[0]: s for s in seen if s[4] != "stalled"}
    every = rocks.createDataFrame([r for rows in batches for r in rows], SHAPE).withColumn("at", F.unix_seconds("at"))
    want = {r.run: (r.run, r.stage, r.steps, r.clock, r.state, r.code) for r in progress.overall(every, STEPS).collect()}
    assert last == want


def test_lines_of_the_protocol_there_and_back(spark, tmp_path):
    rows = [("read", 1, 4, "x"), ("read", 3, 4, "a\tb"), ("write", 0, 0, None)]
    spark.createDataFrame(rows, "label string, i int, n int, note string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("label string, i int, n int, note string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        assert runs.emit(progress.latest(stream.fillna("", ["note"])).drop("share"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    again = progress.parsed(spark.read.text(str(tmp_path / "out/*")))
    assert {tuple(r) for r in again.collect()} == {("read", 3, 4, "a\tb"), ("write", 0, 0, "")}


def test_what_is_stored_is_not_computed_again(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def compute(rows):
        def run(frames):
            for frame in frames:
                count.add(len(frame))
                yield frame[["key"]].assign(n=frame["text"].str.len())

        return rows.mapInPandas(run, "key string, n long")

    def call(texts, version="v1"):
        before = count.value
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
        got = sorted((r.id, r.n) for r in cache.through(rows, F.col("text"), str(tmp_path / "store"), version, compute).collect())
        assert got == [(i, None if t is None else len(t)) for i, t in enumerate(texts)]
        return count.value - before

    assert call(["a", "bb", "a", None, ""]) == 3 and call(["a", "bb", "a", None, ""]) == 0
    assert call(["bb", "ccc"]) == 1 and call(["bb", "ccc"], "v2") == 2 and call(["ccc"], "v1") == 0
    assert call([]) == 0


def test_table_functions_equal_the_operators(spark):
    from plyframe import sql
    from plyframe.operators import tokens as N

    sql.register(spark)
    rows = [(1, "1. e4 e5 2. Nf3 (2. f4 exf4 3. Nf3) 2... Nc6 A good move; 3. Bb5 a6 [3... Nf6 4. 0-0] 4. Ba4 1-0"), (2, "a) 1. e4, b) 1. d4 (see c) x"), (3, ""), (4, None), (5, "prose only"), (6, ")) 3. Nf3 ( 3. e4 ) 3... e5")]
    pages = spark.createDataFrame(rows, "page int, text string")
    pages.createOrReplaceTempView("some_pages")
    for lang in ("en", "fr"):
        toks = N.tokens(pages.fillna("", ["text"]), lang)
        got = spark.sql(f"SELECT page, t.* FROM some_pages, LATERAL book_tokens_{lang}(text) AS t").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, toks.select("page", "idx", "kind", "value", "start", "end").collect()))
        got = spark.sql(f"SELECT page, t.idx, t.value, t.depth, t.ply, t.start FROM some_pages, LATERAL book_moves_{lang}(text) AS t").collect()
        assert sorted(map(str, got)) == sorted(map(str, N.variations(toks).select("page", "idx", "value", "depth", "ply", "start").collect()))
