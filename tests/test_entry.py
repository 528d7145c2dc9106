"""The entry file, with and without the training-data subpackage."""

from __future__ import annotations

import sys

import __spark_entry__ as entry


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_subpackage(monkeypatch):
    base = set(entry.catalogue.queries())
    for name in [m for m in sys.modules if m == "windlass.llm" or m.startswith("windlass.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "windlass.llm", None)  # an import of it now fails
    assert set(entry.queries()) == base
    assert set(entry.oracle_sql()) <= base
