"""Every query runs; those with SQL give the same rows."""

from __future__ import annotations

import pytest
from helpers import run_sql, same

from terrace.oracles import ORACLES
from terrace.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tiny, name):
    same(QUERIES[name](spark, tiny).toPandas(), run_sql(tiny, ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, tiny, name):
    assert len(QUERIES[name](spark, tiny).toPandas()) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
