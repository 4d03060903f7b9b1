"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the DuckDB SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, -0.0 as 0.0: sums in another order differ in the last bits."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return df.withColumns({f.name: F.round(f.name, digits) + 0.0 for f in df.schema if isinstance(f.dataType, T.DoubleType)})
