"""The driver contract: names, oracles and the flagship."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p4_found"} <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["app", "rec", "name_ord", "score", "reason"]
