"""The entry point where a library of the corpus operators is missing."""

import sys

import pytest

import __spark_entry__ as entry_points
from workload.oracle import ORACLE
from workload.queries import REGISTRY


@pytest.mark.parametrize("missing", ["ahocorasick", "saleslens.llm"])
def test_other_queries_register_without_a_library(missing, monkeypatch):
    for name in [n for n in sys.modules if n.startswith("saleslens.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(entry_points.queries()) == set(REGISTRY)
    assert set(entry_points.oracle_sql()) == set(ORACLE)
