"""The pN queries against their SQL on the smallest tables, and their columns."""

import importlib

import pytest

from skarn.llm import MODULES
from tests.conftest import rows

LLM = [importlib.import_module(m) for m in MODULES]
QUERIES = {n: q for m in LLM for n, q in m.QUERIES.items()}
SQL = {n: s for m in LLM for n, s in m.SQL.items()}
COLUMNS = {
    "p1_found": ["ticker_a", "ticker_b"], "p2_found": ["label_direction", "label_magnitude"], "p3_found": ["event_id", "permno", "trade_date"],
    "p4_found": ["record_id_a", "record_id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, small, name):
    a, b = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() >= 0
