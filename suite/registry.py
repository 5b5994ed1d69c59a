"""Registration of queries, and the rounding both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register a query; `digits` rounds its computed doubles, the same way in Spark and in the SQL."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            for column, d in (digits or {}).items():
                df = df.withColumn(column, F.round(column, d))
            return df

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
            if digits:
                rounded = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in digits.items())
                ORACLES[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql}) AS result"
        return fn

    return wrap
