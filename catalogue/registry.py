from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under a name, with the SQL that must agree with it."""

    def add(run: Runner) -> Runner:
        if name in CATALOGUE:
            raise ValueError(f"{name} is registered twice")
        CATALOGUE[name] = Query(run, sql)
        return run

    return add
