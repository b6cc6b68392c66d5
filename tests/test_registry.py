"""Every registered array query against its SQL on the comparison engine, and its plan where it matters."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import gridloom.plans.axisquery  # noqa: F401  (register their queries)
import gridloom.plans.gridquery  # noqa: F401
import gridloom.plans.relations  # noqa: F401
import gridloom.plans.sourcequery  # noqa: F401
from gridloom.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(plain(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunk_predicate_reaches_the_scan(spark):
    plan = plan_of(QUERIES["chunk_pruned"](spark, SF))
    assert "GreaterThanOrEqual(vec_id,100)" in plan and "LessThan(vec_id,180)" in plan and "label" not in plan.split("ReadSchema")[1].split(">")[0]


@pytest.mark.parametrize("name", ["sel_index", "calibrated", "plane_transposed", "healpix_nest2ring", "morton", "cf_time", "surface_height"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    assert "CartesianProduct" not in plan_of(QUERIES[name](spark, SF))
