import math

import duckdb
import pytest

import __spark_entry__
from docketry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert plain(tuple(r[names.index(c)] for c in columns) for r in got.fetchall()) == plain(frame.select(*[f"`{c}`" for c in columns]).collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_verify_out_has_all_lines(spark):
    assert catalog.view(spark, SF, "verify_out").count() == catalog.view(spark, SF, "lineitem").count()
