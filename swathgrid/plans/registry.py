"""Named queries: inventory ids, the Spark plan, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from swathgrid.plans.fixtures import with_fixtures

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    plan: Plan
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        text = with_fixtures(oracle) if oracle else None
        QUERIES[name] = Query(name, ids, plan, text)
        return plan

    return add
