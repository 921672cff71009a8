import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, ids string, size string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names clash with those that operators make."""

    def run(rows, shape=SHAPE):
        full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, len(t or ""), "clash", "clash") for i, t in rows]
        return spark.createDataFrame(full, shape)

    return run


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied texts; a null id."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "one two three four five six"), (5, "one two three four five six"), (6, "one two three four five six"), (None, "no id at all here"), (7, "é ü \u00a0x")]
