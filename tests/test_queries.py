"""Each registered query against its SQL twin on the smallest tables."""

import os

import pytest

from locuspark.plans import aggregate_queries, model_queries, operator_queries, pipeline_queries  # noqa: F401
from locuspark.plans.registry import QUERIES, SQL

from .oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], SQL[name], SF)


def test_entry_imports():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
