"""Every registered query runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from bytelode.plans import queries as core
from tests.duck import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, name: str) -> None:
    same(core.QUERIES[name](spark, SF), connect(SF).sql(core.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted({*core.QUERIES} - {*core.ORACLES}))
def test_runs(spark, name: str) -> None:
    assert core.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark) -> None:
    assert entry.entry(spark).count() > 0
    assert {*core.QUERIES} <= {*entry.queries()}
    assert {*entry.oracle_sql()} <= {*entry.queries()}
