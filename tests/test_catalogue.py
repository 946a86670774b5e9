"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check import compare, database
from catalogue import CATALOGUE
from tests.conftest import SMALL, final_plan


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def no_detours(frame) -> None:
    """The adaptive plan after a run: no cross join, no Python worker."""
    plan = final_plan(frame)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InArrow", "InPandas"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOGUE.items() if q.sql is not None))
def test_equal_to_sql(spark, con, name):
    frame = CATALOGUE[name].run(spark, SMALL)
    assert compare(spark, con, SMALL, name, frame).startswith("equal")
    no_detours(frame)


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOGUE.items() if q.sql is None))
def test_runs(spark, name):
    frame = CATALOGUE[name].run(spark, SMALL)
    assert len(frame.collect()) > 0
    no_detours(frame)
