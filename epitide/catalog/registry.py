"""A registered query: a name, the Spark plan, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from epitide.catalog.views import Views, with_views
from epitide.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Views], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Views(configure(spark), folder))

    def oracle(self) -> str | None:
        return with_views(self.sql) if self.sql else None


class Registry:
    """Collects the queries of one module; used as a decorator."""

    def __init__(self) -> None:
        self.items: list[Query] = []

    def add(self, name: str, sql: str | None = None):
        def register(plan: Callable[[Views], DataFrame]):
            self.items.append(Query(name, plan, sql))
            return plan

        return register
