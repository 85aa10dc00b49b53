"""Registry of named queries, each with its DataFrame plan and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None
    covers: tuple[str, ...]


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, covers: str = "") -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(name, plan, sql, tuple(covers.split()))
        return plan

    return add
