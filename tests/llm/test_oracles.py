"""The queries of the package against SQL over the same whole tables, and the guard of the entry point."""

from __future__ import annotations

import pytest
from helpers import run_sql, same

from terrace.llm.oracles import ORACLES
from terrace.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tiny, name):
    same(QUERIES[name](spark, tiny).toPandas(), run_sql(tiny, ORACLES[name]))


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in entry.queries() if q[:2] == "op"}
    assert "pipeline" in entry.queries()
