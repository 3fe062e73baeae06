"""The registered queries: name, Spark plan, and SQL for the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None = None


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def add(self, name: str, plan: Plan, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query registered twice: {name}")
        self.queries[name] = Query(name, plan, sql)


REGISTRY = Registry()


def all_queries() -> dict[str, Query]:
    from riskloom.plans import checks, features, graph, investigation, models, retrieval, tables  # noqa: F401

    return REGISTRY.queries
