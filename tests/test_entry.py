from __future__ import annotations

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).limit(5).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
