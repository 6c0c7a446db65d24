import random

import pandas as pd
import pytest

from tests.oracle import DATA, connect, duck_rows, spark_rows
from tidemark.llm import licenses, mixing, oracles, pii, queries


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_rows_equal_those_of_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == duck_rows(connect(), oracles.SQL[name])


def over(rows, sql):
    """The rows of the SQL over documents (doc_id, source, text)."""
    con = connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"}).astype(object).where(lambda d: d.notna(), None))
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(source AS VARCHAR) AS source, CAST(text AS VARCHAR) AS text FROM given")
    return duck_rows(con, sql)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_found_identifiers_equal_those_of_sql(spark):
    rng = random.Random(5)
    seeds = [lambda: f"u{rng.randint(1, 60)}@ex.org", lambda: f"10.0.{rng.randint(0, 9)}.{rng.randint(1, 299)}", lambda: f"+1 974 555 {rng.randint(1000, 1030)}", lambda: "4111 1111 1111 1111"]
    ids = [lambda: f"ID-{rng.randint(100000, 100040)}", lambda: f"x{rng.randint(10**6, 10**6 + 30)}", lambda: f"{rng.randint(10, 99)}"]
    words = "contact mail the user at host number Über is of".split()
    rows = [(1, "a", None), (2, "a", ""), (3, None, "no digits")]
    for k in range(10, 260):
        out = []
        for _ in range(rng.randint(1, 12)):
            out += rng.choices(words, k=rng.randint(0, 4)) + [rng.choice(seeds if rng.random() < 0.4 else ids)()]
        rows.append((k, "a", rng.choice([" ", ", ", "\n"]).join(out) + rng.choice(["", " end", "!"])))
    got = spark_rows(pii.find_pii(documents(spark, rows)))
    assert got == over(rows, oracles.SQL["op1_pii"])
    assert sum("id:" in "".join(r) for r in got[1]) > 50


def test_template_spans_equal_those_of_sql(spark):
    rng = random.Random(6)
    rows = [(1, "a", None), (2, "a", ""), (3, None, "MIT License, mit-license")]
    for k in range(10, 160):
        words = []
        for _, text in rng.choices(licenses.TEMPLATES, k=rng.randint(1, 3)):
            kept = text.split()
            for _ in range(rng.randint(0, len(kept) // 6)):
                i = rng.randrange(len(kept))
                kept[i : i + rng.randint(0, 3)] = rng.choice([[], ["of", "the", "software"], ["other"]])
            words += kept + ["word"] * rng.randint(0, 40)
        rows.append((k, "a", " ".join(words)))
    got = spark_rows(licenses.license_scan(documents(spark, rows)))
    assert got == over(rows, oracles.SQL["op3_license_scan"])
    at = got[0].index("template_spans")
    assert sum(len(r[at]) > 2 for r in got[1]) > 100


def test_mix_equals_that_of_sql(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["a"] * 6 + ["b", "c", "dé", "", None]), rng.choice([None, "", " ", *["w " * rng.choice([1, 2, 3, 4, 7, 8, 9, 30, 500])] * 30])) for k in range(3000)]
    got = spark_rows(mixing.mix_report(documents(spark, rows)))
    assert got == over(rows, oracles.SQL["op10_mixing"])
