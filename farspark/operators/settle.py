"""Cut lineage where a plan is read many times, in storage that outlives an executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a plan is run once: its shuffle files go when it ends, and what a Python worker gets at once is bounded in bytes, so that
#: long texts do not fill it. Texts are read by fewer rows at once for the same reason.
_WHILE = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
#: Bytes a task gathers before it writes them as a row group.
ROW_GROUP = 16 << 20
_scopes: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """Where this application keeps intermediate tables: the session's shared checkpoint folder, else its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/farspark-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside go at the end, but for those settled with `keep`, which belong to the scope around."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files, where = _file_system(spark, path)
            files.delete(where, True)


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """Plans that are run inside are not run again, and their batches are bounded in bytes."""
    before = {name: spark.conf.get(name, None) for name in _WHILE}
    for name, value in _WHILE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def settle(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write `df` once as Parquet to the cluster's shared folder and read it back.

    Column pruning and pushed filters work on the copy, and a lost executor costs nothing that was written.
    The copy goes when its scope of `temporaries` or else the application ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    with run_once(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
