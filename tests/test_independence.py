"""The library imports and runs without the training-data subpackage."""

import sys

import __spark_entry__ as entry


def test_catalogue_does_not_need_llm():
    from plateworks.plans import catalogue

    assert set(catalogue.queries()) <= set(entry.queries())
    named = [m for m in sys.modules if m.startswith("plateworks.") and ".llm" not in m]
    for m in named:
        source = getattr(sys.modules[m], "__file__", None)
        if source:
            with open(source) as f:
                assert "plateworks.llm" not in f.read()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
