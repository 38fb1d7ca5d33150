import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, key string, digest string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table, with columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None, "x", "k", "d") for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i * i % 9973}" for i in range(30_000))
    shared = " ".join(f"shared{i}" for i in range(60))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, f"a b {long} c"), (7, "repeat " * 300),
        (8, f"before {shared} after"), (9, f"{shared}"), (9, f"{shared}"), (10, f"x {shared} y {shared} z"),
        (None, f"lost {shared}"), (11, "é" * 400), (12, "ÀÉ ß\u00a0x  y\u2003z"), (13, "one"), (13, "two"),
    ]
