"""Exact ranks, order statistics and running aggregates over globally ordered data.

A window without a partition key, or one partitioned by a hot key, puts all its rows in one task. Everything
here avoids that in the same way: a numeric column is cut into *cells* that keep its order, the window runs
inside a cell, and the totals of the cells before it are carried in. The result is exact whatever the quality
of the cut points; they only decide how even the work is. Rows with equal values are aggregated first, so a
value that fills a third of the table is one row by the time it reaches a window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from farspark.operators.settle import settle

CELL_ROWS = 500_000
_TAIL = (1e-5, 1e-4, 1e-3)
_QUANTILES = tuple(sorted({i / 120 for i in range(1, 120)} | set(_TAIL) | {1 - t for t in _TAIL}))


@dataclass(frozen=True)
class Cells:
    """Order-keeping cut of one numeric column into cells of about `CELL_ROWS` rows.

    Quantile splits come first, then equal-width cells between neighbouring splits; both steps are monotone
    in the value, including its floating-point rounding. `hot` lists the values that fill whole quantiles; each
    is a split, so it is the smallest value of its cell.
    """

    rows: int
    splits: tuple[float, ...]
    sub: int
    hot: tuple[float, ...] = ()

    @classmethod
    def fit(cls, df: DataFrame, value, by: Sequence[str] = (), cell_rows: int | None = None) -> Cells:
        """One narrow pass; the driver receives a single row of some 130 numbers."""
        v = F.col(value) if isinstance(value, str) else value
        v = F.when(~F.isnan(v.cast("double")), v.cast("double"))
        row = df.agg(
            F.count(v).alias("n"),
            F.min(v).alias("lo"),
            F.max(v).alias("hi"),
            F.percentile_approx(v, list(_QUANTILES), 2000).alias("q"),
        ).first()
        return cls.of_quantiles(row["n"], row["lo"], row["hi"], row["q"] or (), cell_rows)

    @classmethod
    def of_quantiles(cls, rows, lo, hi, quantiles, cell_rows=None) -> Cells:
        target = cell_rows or CELL_ROWS
        splits = sorted({float(x) for x in (lo, *quantiles, hi) if x is not None and math.isfinite(x)})
        if splits and splits[-1] < 1e308:
            splits.append(math.nextafter(splits[-1], math.inf))  # so that the largest value opens a cell too
        sub = max(1, math.ceil(rows / target / max(1, len(splits) - 1)))
        hot = sorted({float(a) for a, b in zip(quantiles[:-1], quantiles[1:]) if a == b and a in splits[:-1]})
        return cls(rows, tuple(splits), sub, tuple(hot))

    def attach(self, df: DataFrame, value: str, name: str = "_cell") -> DataFrame:
        """Add the cell of a value: BIGINT, non-decreasing in the value.

        A binary search over a literal array, one projection per step. Each step reads the one before it twice,
        so the optimiser keeps them apart, and the generated code stays small enough to be compiled: the same
        search as one nested CASE is ten times slower.
        """
        m = len(self.splits)
        if m < 2:  # no finite value, or one infinite end: one cell
            return df.withColumn(name, F.lit(0).cast("bigint"))
        steps = m.bit_length()
        padded = F.lit([*self.splits, *[math.inf] * (2**steps - 1 - m)])
        width = [b - a for a, b in zip(self.splits[:-1], self.splits[1:])]
        scale = F.lit([self.sub / w if math.isfinite(w) and math.isfinite(self.sub / w) else 0.0 for w in width])
        d = df.withColumn("_v", F.col(value).cast("double")).withColumn("_at", F.lit(0))
        for step in reversed(range(steps)):
            beyond = F.get(padded, F.col("_at") + (2**step - 1)) <= F.col("_v")
            d = d.withColumn("_at", F.col("_at") + F.when(beyond, 2**step).otherwise(0))
        d = d.withColumn("_at", F.least(F.greatest(F.col("_at") - 1, F.lit(0)), F.lit(m - 2)))
        inner = F.floor((F.col("_v") - F.get(padded, F.col("_at"))) * F.get(scale, F.col("_at")))
        inner = F.least(F.greatest(inner, F.lit(0)), F.lit(self.sub - 1))
        return d.withColumn(name, (F.col("_at") * self.sub + inner).cast("bigint")).drop("_v", "_at")


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
            F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        )
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def running(
    df: DataFrame,
    order: Sequence[str],
    scans: dict[str, tuple[str, Column | str, bool]],
    cells: Cells,
    by: Sequence[str] = (),
    descending: bool = False,
    tie_cells: Cells | None = None,
) -> DataFrame:
    """Add running aggregates in the order of `order` (first column numeric, the one `cells` was fitted on).

    `scans` maps a new column to (kind, column, inclusive); kinds are sum, max and min. The order must have no
    ties that matter: break them with further order columns. NULL where nothing precedes.

    Rows that cannot be aggregated by value beforehand may still share one value. With `tie_cells`, fitted on
    the second order column, the rows of a hot value are cut further by that column; they come first in their
    cell, so (cell, tie cell) keeps the order.
    """
    by = list(by)
    split_ties = tie_cells is not None and bool(cells.hot) and not descending
    d = cells.attach(df, order[0])
    if split_ties:
        last = len(tie_cells.splits) * tie_cells.sub
        is_hot = F.col(order[0]).cast("double").isin(*cells.hot)
        d = tie_cells.attach(d, order[1], "_tie").withColumn("_tie", F.when(is_hot, F.col("_tie")).otherwise(last))
    d = settle(d)  # read for the windows and for the totals; chained scans would double the work each time
    place = ["_cell", "_tie"] if split_ties else ["_cell"]
    sign = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    w = W.partitionBy(*by, *place).orderBy(*[sign(c) for c in order])
    column = lambda c: F.col(c) if isinstance(c, str) else c
    out = d
    for name, (kind, c, inclusive) in scans.items():
        frame = w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        out = out.withColumn(name, _AGG[kind](column(c)).over(frame))
    totals = d.groupBy(*by, *place).agg(*[_AGG[k](column(c)).alias(f"_t_{n}") for n, (k, c, _) in scans.items()])
    # One row per cell: rows / CELL_ROWS of them, so this window is small by construction.
    wc = W.partitionBy(*by).orderBy(*[sign(c) for c in place]).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *by, *place, *[_AGG[k](f"_t_{n}").over(wc).alias(f"_c_{n}") for n, (k, _, _) in scans.items()]
    )
    out = out.join(carry, [*by, *place], "left")
    for name, (kind, _, _) in scans.items():
        out = out.withColumn(name, _combine(kind, F.col(name), F.col(f"_c_{name}")))
    return out.drop(*place, *[f"_c_{n}" for n in scans])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), **extra: Column) -> DataFrame:
    """One row per distinct value with its count `n` (and further sums); NaN and NULL values are left out."""
    keep = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    aggs = [F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()]]
    return df.filter(keep).groupBy(*by, value).agg(*aggs)


def counts_at_least(values: DataFrame, value: str, cells: Cells, by: Sequence[str] = (), **sums: str) -> DataFrame:
    """Inclusive suffix sums down a table of distinct values: rows at or above each value."""
    scans = {out: ("sum", column, True) for out, column in sums.items()}
    return running(values, [value], scans, cells, by, descending=True)


def select_ranks(
    df: DataFrame, value: str, wanted: DataFrame, cells: Cells, by: Sequence[str] = ()
) -> DataFrame:
    """Exact order statistics: add `value` at each `rank` (1 = largest) of `wanted` (by..., rank, ...).

    Two scans, no sort of the data: count rows per cell, then look only inside the cells that hold a wanted
    rank. The shuffles carry cell counts and the distinct values of those few cells.
    """
    by = list(by)
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, value)
    one = F.lit(0).alias("_all") if not by else None
    if one is not None:
        d, wanted = d.select("*", one), wanted.withColumn("_all", F.lit(0))
        by = ["_all"]
    d = cells.attach(d, value)
    hist = d.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    down = W.partitionBy(*by).orderBy(F.col("_cell").desc()).rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumn("_upto", F.sum("_n").over(down)).withColumn("_before", F.col("_upto") - F.col("_n"))
    # One row per group and rank, read by both branches below.
    target = settle(
        wanted.join(hist, by, "inner")
        .filter((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_upto")))
        .withColumn("_rank_in_cell", F.col("rank") - F.col("_before"))
        .drop("_n", "_upto", "_before")
    )
    rows = d.join(target.select(*by, "_cell").distinct(), [*by, "_cell"], "left_semi")
    inside = rows.groupBy(*by, "_cell", value).agg(F.count(F.lit(1)).alias("_n"))
    down = W.partitionBy(*by, "_cell").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.sum("_n").over(down))
    hit = (F.col("_upto") >= F.col("_rank_in_cell")) & (F.col("_upto") - F.col("_n") < F.col("_rank_in_cell"))
    return (
        inside.join(target, [*by, "_cell"])
        .filter(hit)
        .drop("_cell", "_n", "_upto", "_rank_in_cell", "_all")
    )


def group_sizes(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    keep = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.filter(keep).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def percentiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = (), cells: Cells | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of `quantiles`.

    The built-in aggregate keeps a map of every distinct value of a group, so the ranks are selected instead.
    A group without values, or a table without rows and groups, has a row of NULLs.
    """
    by = list(by)
    cells = cells or Cells.fit(df, value, by)
    clean = df.withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value)).cast("double"))
    spots = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()])
    place = (
        group_sizes(clean, value, by)
        .select(*by, "n", F.explode(spots).alias("s"))
        .select(*by, "n", "s.name", ((F.col("n") - 1) * F.col("s.q")).alias("at"))
    )
    ends = place.select(
        *by, "name", "at", "n", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("ascending")
    ).withColumn("rank", F.col("n") - F.col("ascending"))
    found = select_ranks(clean, value, ends.dropDuplicates([*by, "name", "rank"]), cells, by)
    at = F.first("at")
    lerp = found.groupBy(*by, "name").agg(
        F.when(F.min(value) == F.max(value), F.min(value))  # infinite ends too
        .otherwise(F.min(value) + (F.max(value) - F.min(value)) * (at - F.floor(at))).alias("p")
    )
    wide = lerp.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("p"))).alias(k) for k in quantiles])
    return df.select(*by).distinct().join(wide, by, "left") if by else wide


def ordinal(
    df: DataFrame, order: Sequence[str], cells: Cells, name: str = "ordinal", by: Sequence[str] = (),
    tie_cells: Cells | None = None,
) -> DataFrame:
    """0-based position in the order of `order`, as a running count."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = running(one, order, {name: ("sum", "_one", True)}, cells, by, tie_cells=tie_cells)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def as_of(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, payload: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Attach to each left row the payload of the right row with the largest key not above its own.

    No range join: both sides become one ordered stream, and the latest right row is a running maximum of
    (key, payload). NULL payload where no right row precedes. Left keys are distinct values by then.
    """
    by = list(by)
    probe = left.select(*by, F.col(left_key).cast("double").alias("_k")).distinct()
    empty = F.lit(None)
    latest = F.struct(F.col(right_key).cast("double").alias("_rk"), *[F.col(c) for c in payload])
    kind = right.select(*by, latest.alias("_p")).schema["_p"].dataType
    stream = right.select(
        *by, F.col(right_key).cast("double").alias("_k"), F.lit(0).alias("_side"), latest.cast(kind).alias("_p")
    ).unionByName(probe.select(*by, "_k", F.lit(1).alias("_side"), empty.cast(kind).alias("_p")))
    cells = Cells.fit(stream, "_k", by)
    scanned = running(stream, ["_k", "_side"], {"_latest": ("max", "_p", True)}, cells, by)
    found = scanned.filter(F.col("_side") == 1).select(*by, "_k", *[F.col(f"_latest.{c}").alias(c) for c in payload])
    keyed = left.withColumn("_k", F.col(left_key).cast("double"))
    return keyed.join(found, [*by, "_k"], "left").drop("_k")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
