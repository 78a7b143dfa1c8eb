import importlib

import pytest

import __spark_entry__ as entry
from pileline.plans import catalog


def test_the_engine_stays_where_the_rest_cannot_be_imported(monkeypatch):
    whole = entry.queries()
    assert set(catalog.QUERIES) <= set(whole)
    real = importlib.import_module

    def broken(name, *a):
        if name.startswith(("pileline.llm", "corpus_pipeline")):
            raise ImportError("no such library")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", broken)
    if len(whole) > len(catalog.QUERIES):
        with pytest.warns(UserWarning, match="left out"):
            assert set(entry.queries()) == set(catalog.QUERIES)
        with pytest.warns(UserWarning, match="left out"):
            assert set(entry.oracle_sql()) == set(catalog.SQL)
