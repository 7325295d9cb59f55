"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from strandql import queries as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = oracle.execute(catalogue.SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in want.description], want.fetchall())


def test_sample(spark):
    assert catalogue.QUERIES["sample_n"](spark, SF).count() == 50


def test_entry(spark):
    found = entry.entry(spark).collect()
    assert len(found) == 6 and found[0]["rf"] == "A" and found[0]["n"] == 510
    assert set(entry.oracle_sql()) <= set(entry.queries())
