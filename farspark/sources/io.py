"""Readers and writers. Spark's own sources do the work; these add schemas, shapes and refusals."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from farspark import schemas
from farspark.errors import RefusedError
from farspark.operators.segments import completeness_check

_ROWS = "array<array<string>>"


def read_segments(spark: SparkSession, path: str, channel: str | None = None, drop_event: bool = False) -> DataFrame:
    """Segment lists as JSON: {"segments": [[start, end, duration, event]]}, {channel: [[start, end]]} or a bare list.

    A file is one document, so it is read whole; use a table for segment lists that do not fit one file.
    """
    text = spark.read.text(path, wholetext=True).withColumn("value", F.trim("value"))
    listed = F.from_json("value", f"struct<segments:{_ROWS}>")["segments"]
    keyed = F.from_json("value", f"map<string,{_ROWS}>")
    bare = F.from_json("value", _ROWS)
    is_bare = F.col("value").startswith("[")
    label = F.lit(channel).cast("string")
    picked = (
        F.when(is_bare, F.array(F.struct(label.alias("channel"), bare.alias("rows"))))
        .when(listed.isNotNull(), F.array(F.struct(label.alias("channel"), listed.alias("rows"))))
        .otherwise(F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("channel"), e["value"].alias("rows"))))
    )
    lists = text.select(F.explode(picked).alias("l")).select("l.channel", "l.rows")
    if channel is not None:
        lists = lists.filter(F.col("channel") == channel)
    else:
        names = [r[0] for r in lists.select("channel").distinct().limit(2).collect()]
        if len(names) > 1 or names == [None]:
            raise RefusedError(f"{path} does not name one channel; pass channel=")
    event = F.try_element_at("r", F.lit(4))
    rows = lists.select("channel", F.explode("rows").alias("r")).select(
        "channel", F.element_at("r", 1).cast("double").alias("start_s"), F.element_at("r", 2).cast("double").alias("end_s"),
        F.when(event != "", event).alias("event"),
    )
    if drop_event:
        rows = rows.filter(F.col("event").isNull())
    if rows.isEmpty():
        raise RefusedError(f"{path}: no segments left")
    return rows


def named_events(segments: DataFrame) -> DataFrame:
    """The event names segments carry, with the segment's start."""
    return segments.filter(F.col("event").isNotNull()).select("event", "start_s")


def read_grid(spark: SparkSession, path: str, required: Sequence[str] = schemas.GRID_REQUIRED) -> DataFrame:
    """Score grid. Columns outside the schema are never read; ones the query needs must exist in the files."""
    schemas.require_columns(spark.read.parquet(path), required, path)
    return spark.read.schema(schemas.GRID).parquet(path)


def write_grid(grid: DataFrame, path: str, part_seconds: float = 86400.0) -> None:
    """Append the spans the target does not hold yet. Files are laid out by stretch of time, not one per span."""
    spark = grid.sparkSession
    try:
        done = spark.read.parquet(path).select("span_start").distinct()
        grid = grid.join(done, "span_start", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    part = F.floor(F.col("span_start") / F.lit(part_seconds)).cast("bigint")
    grid.withColumn("part", part).write.mode("append").partitionBy("part").parquet(path)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Tile bank; a tile without a label gets NaN."""
    bank = spark.read.schema(schemas.BANK).parquet(path)
    return bank.withColumn("y", F.coalesce("y", F.lit(float("nan")).cast("float")))


def write_triggers(triggers: DataFrame, meta: DataFrame, path: str) -> None:
    """Triggers and the one-row description of how they were made; neither is ever overwritten or restamped."""
    schemas.require_columns(meta, schemas.names(schemas.RUN_META), "run metadata")
    triggers.write.mode("errorifexists").parquet(os.path.join(path, "triggers"))
    meta.coalesce(1).write.mode("errorifexists").parquet(os.path.join(path, "meta"))


def read_triggers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(os.path.join(path, "triggers")), spark.read.parquet(os.path.join(path, "meta"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRIALS).json(path)


def collect_records(spark: SparkSession, directory: str, pattern: str = "*/summary.json", per_line: bool = False) -> DataFrame:
    """Every run record under a directory, one to a file or one to a line; keys outside the schema are dropped."""
    return spark.read.schema(schemas.RECORDS).json(os.path.join(directory, pattern), multiLine=not per_line)


# The names a reference curve's columns go by.
FREQUENCY_NAMES = ("freq", "freqs", "f", "frequency")
POWER_NAMES = ("psd", "PSD", "power")


def read_psd(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Reference curve with its columns under any of the accepted names: (channel if present, freq, psd)."""
    options = {"header": True, "inferSchema": True} if fmt == "csv" else {}
    raw = spark.read.format(fmt).options(**options).load(path)
    f = next((c for c in FREQUENCY_NAMES if c in raw.columns), None)
    p = next((c for c in POWER_NAMES if c in raw.columns), None)
    if f is None or p is None:
        raise RefusedError(f"{path}: expected frequency and power columns, found {', '.join(raw.columns)}")
    kept = [F.col("channel")] if "channel" in raw.columns else []
    return raw.select(*kept, F.col(f"`{f}`").cast("double").alias("freq"), F.col(f"`{p}`").cast("double").alias("psd"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Reference parameter counts {component: count}, JSON or flat YAML, with or without a `components` root."""
    if path.endswith((".yaml", ".yml")):
        lines = spark.read.text(path).select(F.split("value", "#")[0].alias("value"))
        pair = lines.select(
            F.trim(F.regexp_extract("value", r"^\s*([^:]+):\s*(\d+)\s*$", 1)).alias("component"),
            F.regexp_extract("value", r"^\s*([^:]+):\s*(\d+)\s*$", 2).alias("count"),
        )
        return pair.filter(F.col("count") != "").select("component", F.col("count").cast("bigint").alias("count"))
    text = spark.read.text(path, wholetext=True)
    rooted = F.from_json("value", "struct<components:map<string,bigint>>")["components"]
    counts = F.coalesce(rooted, F.from_json("value", "map<string,bigint>"))
    return text.select(F.explode(counts).alias("component", "count"))


__all__ = [
    "collect_records", "completeness_check", "named_events", "read_bank", "read_counts", "read_grid", "read_psd",
    "read_segments", "read_trials", "read_triggers", "write_grid", "write_triggers",
]
