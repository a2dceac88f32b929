"""The registered queries of this package against their SQL, and what the entry point adds."""

import pytest
from compare import compare

import __spark_entry__ as entry_points
from saleslens.llm.oracle import ORACLE
from saleslens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sf_dir, con):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry_point():
    names = entry_points.queries()
    assert set(QUERIES) < set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 1 + max(int(n[2:].split("_")[0]) for n in QUERIES)))
