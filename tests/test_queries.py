import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import DATA, connect, duck_rows, spark_rows
from tidemark import catalog


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, duck, name):
    assert spark_rows(catalog.QUERIES[name](spark, DATA)) == duck_rows(duck, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sliding_stft_judges_every_window(spark):
    filled = catalog.QUERIES["periodogram"](spark, DATA).groupBy("event_type").agg(F.max("k").alias("half"))
    n = {r.event_type: r.half * 2 for r in filled.collect()}  # an odd row more at most
    power = catalog.QUERIES["stft_power"](spark, DATA)
    for r in power.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("window_start").alias("starts"), F.max("window_start").alias("last")).collect():
        assert r.n == r.starts == r.last + 1 and r.n + 23 - n[r.event_type] in (0, 1)
    centres = [r.centre for r in catalog.QUERIES["stft_anomalies"](spark, DATA).collect()]
    assert {c % 4 for c in centres} == {0, 1, 2, 3} and len(centres) == pytest.approx(0.05 * power.count(), rel=0.1)
