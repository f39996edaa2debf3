"""Named queries over a folder of Parquet tables, each with its SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Tables:
    """Attribute access to the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self._folder}/{name}.parquet"

    def stream(self, name: str, **options) -> DataFrame:
        """The table's files as a stream. The pattern form of the path holds for a file and for a folder."""
        schema = self.spark.read.parquet(self.path(name)).schema
        return self.spark.readStream.schema(schema).options(**options).parquet(f"{self._folder}/{name[:-1]}[{name[-1]}].parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = Query(lambda spark, folder: build(Tables(spark, folder)), sql)
        return build

    return register


def r(expression: str, digits: int) -> str:
    """SQL for scaled half-even rounding."""
    scale = f"{10**digits}::DOUBLE"
    return f"(round_even(({expression}) * {scale}, 0) / {scale} + 0::DOUBLE)"
