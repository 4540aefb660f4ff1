"""Registry of runnable queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Fixed value: rows of a table in memory, at least this many times its Parquet files
FILE_GROWTH = 16


def sized_by_rows(fn: Query) -> Query:
    """Let Spark take the size of a table as that of its rows, not of its compressed files, when it chooses joins.

    Otherwise tables of millions of rows count as small enough to broadcast, several at once, through the driver.
    """

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(FILE_GROWTH)))
        return fn(spark, sf_dir)

    return run


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = sized_by_rows(fn)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
