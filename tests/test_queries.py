"""Every core query against its SQL on the smallest tables."""

import importlib
import sys

import pytest

import __spark_entry__ as entry
from tests.conftest import rows

CORE = [importlib.import_module(m) for m in entry.MODULES]
QUERIES = {n: q for m in CORE for n, q in m.QUERIES.items()}
SQL = {n: s for m in CORE for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, small, name):
    a, b = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "skarn.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    e = importlib.import_module("__spark_entry__")
    assert e.LLM_MODULES == [] and "p5_found" in e.queries() and "p1_found" not in e.queries()


def test_nothing_outside_imports_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in (root / "skarn").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "skarn.llm" not in p.read_text()
