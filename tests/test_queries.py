import oracle
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
ORACLE = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(driver.queries()))
def test_query(spark, duck, name):
    query = driver.queries()[name]
    if name in ORACLE:
        assert oracle.difference(spark, duck, query, ORACLE[name], SF) is None
    else:
        assert query(spark, SF).count() > 0


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["conv_id", "n_messages", "n_chars", "digest"] and df.count() > 0


def test_corpus_fingerprint_repeats(spark):
    query = driver.queries()["corpus_fingerprint"]
    assert query(spark, SF).first() == query(spark, SF).first()
