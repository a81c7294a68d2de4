"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from fluxgrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def canonical(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    rows = [tuple(r[columns.index(n)] for n in names) for r in want.fetchall()]
    assert canonical(tuple(r[n] for n in names) for r in got.collect()) == canonical(rows)


def test_no_nested_loops_in_the_flagship(spark):
    plan = catalog.QUERIES["fusion_replay"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
