"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import compare

import __spark_entry__ as entry_points

from workload.oracle import ORACLE
from workload.queries import REGISTRY as QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, sf_dir, con):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
