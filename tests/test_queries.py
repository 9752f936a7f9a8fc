"""Every query beside its SQL on the smallest tables; queries without SQL must run."""

from pathlib import Path

import pytest
from oracle import compare, connect

from gaugeloom.plans import controls, evaluation, records

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = {**records.QUERIES, **evaluation.QUERIES, **controls.QUERIES}, {**records.ORACLE, **evaluation.ORACLE, **controls.ORACLE}

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        assert compare(spark, duck, name, QUERIES[name], SQL[name], DIR) == ""
    else:
        df = QUERIES[name](spark, DIR)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1 and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push(spark):
    """Only needed columns are read, and no query of the records needs a cross join."""
    plan = QUERIES["attr_scoring"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
    for name in ("p1_found", "p5_found", "p7_found"):
        assert "CartesianProduct" not in QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
