"""Small helpers the operators share: input tables, vocabulary files, and running totals without a hot window."""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vocabulary(path: str) -> str:
    """A vocabulary file: a path, or the bare name of one of the public tokenizers where this process runs."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def held_out(id_col: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def cells_for(largest_group: int) -> int:
    """Cells per group so that a cell holds about as many rows as there are cells: both stay small at any size."""
    return max(1, math.isqrt(max(0, largest_group - 1)) + 1)


def running_total(df: DataFrame, by: Sequence[str], cell: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the group that come before this row.

    `cell` cuts each group into parts that keep the order of `order` (cells ascend with it). A window runs inside
    one cell; totals of earlier cells are carried in, so a group that holds most rows is spread over its cells.
    `df` is read twice and should be settled. Columns called like the helper's own (`_`-prefixed) are not expected.
    """
    keys = [*by, cell]
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*by).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(
        *(F.col(k).alias(f"_{k}") for k in keys), "_carried")
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return (local.join(carried, same, "left")
            .withColumn(name, F.col("_local") + F.coalesce("_carried", F.lit(0)))
            .drop("_local", "_carried", *(f"_{k}" for k in keys)))
