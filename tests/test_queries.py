"""Every registered query of the engine against its SQL, and the driver contract."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__
from mosaique.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    answer = con.execute(SQL[name])
    names = [c[0] for c in answer.description]
    want = sorted(repr(tuple(map(plain, r))) for r in answer.fetchall())
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).columns == ["vec_id", "similarity"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "read"), [("name_search", "p_partkey:bigint,p_name:string"), ("misses_at_scale", "l_orderkey:bigint,l_quantity:double")])
def test_scans_read_only_what_is_needed(spark, sf_dir, name, read):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{read}>" in plan and "PushedFilters: [" in plan
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
