"""Registry of the named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    run: Runner
    sql: str | None
    covers: tuple[str, ...]


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None, covers: str = "") -> Callable[[Runner], Runner]:
    """Register a query under a name, with its checking SQL and the operators it covers."""

    def add(fn: Runner) -> Runner:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = Plan(name, fn, sql, tuple(covers.split()))
        return fn

    return add
