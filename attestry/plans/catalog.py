"""The registry of queries, each with the oracle it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attestry.plans.model import Model, oracle as oracle_text


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Model], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Model(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan over the model, with the text its oracle computes."""

    def wrap(build: Callable[[Model], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(name, build, oracle_text(sql) if sql else None)
        return build

    return wrap


def load() -> dict[str, Query]:
    from attestry.plans import all_queries  # noqa: F401  registers on import

    return QUERIES
