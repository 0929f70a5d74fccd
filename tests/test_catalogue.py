"""Every query of the catalogue against its SQL, and what the plans look like."""

import os

import duckdb
import pytest

from loomtable.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    got = sorted(tuple(map(repr, (r[c] for c in sorted(frame.columns)))) for r in frame.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(frame.columns) == sorted(want.columns)
    assert got == sorted(tuple(repr(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")
def test_triples_need_no_shuffle_and_no_python(spark):
    plan = catalogue.minimal_lineitem(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "Generate explode" in plan
    assert "WholeStageCodegen" in plan or "*(1)" in plan
    narrow = catalogue.null_values(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in narrow  # only the described columns are read
