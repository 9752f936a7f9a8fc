"""Every text query beside its SQL on the smallest tables; queries without SQL must run."""

from pathlib import Path

import pytest
from oracle import compare, connect

from gaugeloom.llm import queries

DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLE:
        assert compare(spark, connect(DIR), name, queries.QUERIES[name], queries.ORACLE[name], DIR) == ""
    else:
        df = queries.QUERIES[name](spark, DIR)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0
