"""The driver's view."""

import __spark_entry__ as e


def test_entry_counts_classes(spark):
    rows = {r.classification: r.n for r in e.entry(spark).collect()}
    assert set(rows) <= {"NEW", "CHANGED", "UNCHANGED"} and sum(rows.values()) > 0


def test_each_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 100
