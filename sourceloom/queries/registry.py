"""Register a query together with the SQL that states what it must return."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name!r} is registered twice")
        PLANS[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan
    return add
