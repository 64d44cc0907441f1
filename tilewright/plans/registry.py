"""Registry of runnable queries and the SQL each one is checked with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tilewright import fixtures

QueryFn = Callable[["Inputs"], DataFrame]


class Inputs:
    """Lazy access to the given tables and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.DEFINITIONS:
            return fixtures.load(self.spark, self.sf_dir, name)
        raise AttributeError(name)


@dataclass(frozen=True)
class Entry:
    name: str
    build: QueryFn
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Inputs(spark, sf_dir))


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may use derived inputs by their plain names."""

    def add(build: QueryFn) -> QueryFn:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, build, fixtures.with_inputs(sql) if sql else None)
        return build

    return add
