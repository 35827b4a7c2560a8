"""Driver contract: entry runs, every SQL oracle has a query."""

import __spark_entry__ as E


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and {"post_id", "success", "message", "fact_check_results"} <= set(df.columns)
