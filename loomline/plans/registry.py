"""The registry of queries: each operator applied to the supplied tables, with SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.sources.scratch import spread

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
#: Tables of long texts.
TEXTS = ("documents", "conversations")


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in TEXTS else table


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. Without ``sql`` a test holds it against brute force."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add
