"""Every registered query with SQL gives the same rows as that SQL in DuckDB; the others run and give rows."""

from __future__ import annotations

from collections import Counter

import compare
import pytest

from tessarine.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    if name in SQL:
        assert compare.differences(spark, duck, small, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, small).columns and QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_approximate_leg_finds_what_the_exact_leg_finds(spark, small):
    """Lists are as long as the exact ones, and hold at least nine tenths of their rows."""
    exact, approx = ({(r.query_id, r.chunk_id) for r in QUERIES[n](spark, small).collect()} for n in ("r5_vector_leg", "r6_vector_leg_approx"))
    assert Counter(q for q, _ in exact) == Counter(q for q, _ in approx)
    assert len(exact & approx) >= 0.9 * len(exact)
