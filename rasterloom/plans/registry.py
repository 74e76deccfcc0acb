"""Queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.operators.staging import shared_folder as shared_folder


class Registry:
    """@registry(name, sql) puts a function of (spark, sf_dir) under a name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
