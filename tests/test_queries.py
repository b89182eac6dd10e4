"""Every registered query against its SQL twin, on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from oracle import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# The text operators are optional and have tests of their own.
TEXT = {name for name in QUERIES if re.match(r"op\d+_|pipeline$", name)}


def test_every_oracle_has_a_query():
    assert set(ORACLES) - TEXT == set(QUERIES) - TEXT


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(set(ORACLES) - TEXT))
def test_matches_sql(spark, duck, sf_dir, name):
    got, want, plan = compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    assert got == want
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
