"""Every query against its SQL on the smallest tables; queries without SQL at least run."""

import math
import os

import duckdb
import pytest

from captionlake.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(names, found):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr([cell(r[i]) for i in at]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, df.collect())
    assert got and got == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_interval_join_is_an_equi_join(spark):
    plan = queries.QUERIES["interval_overlap_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
