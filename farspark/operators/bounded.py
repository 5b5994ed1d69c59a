"""Slid pairs in bound order: those whose statistic can pass a floor, without forming the others.

Wherever a statistic of a pair is at most `part_a` of its row of channel a plus `part_b` of its row of channel b, blocks of
positions carry the largest part of each channel. Two blocks that some lag brings together are compared by those two
numbers, then pair by pair inside the blocks that are left. No plan node holds a row per point and lag.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from farspark.errors import RefusedError
from farspark.operators.settle import settle
from farspark.operators.slides import Selection, SlidePlan, cluster_local_max, span_lags, trigger_lookup

#: Positions of a block.
WIDTH = 512
#: Pairs a task hands on at once.
_BATCH = 1 << 17
PAIRS = "span_start double, lag_index int, k bigint, i bigint, j bigint"
_SLACK = 1e-9


def with_slack(part: Column) -> Column:
    """A part raised by more than its rounding, so that a bound never falls short of the statistic."""
    return part + F.lit(_SLACK) * F.abs(part)


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """One row per block of a span: its parts in order, the largest of each, and what a pair needs."""
    number = lambda c: F.when(~F.isnan(c), F.col(c).cast("double")).alias(c)
    member = F.struct("i", number("part_a"), number("part_b"))
    blk = F.floor(F.col("i") / width).cast("bigint")
    found = rows.groupBy("span_start", "n", blk.alias("blk")).agg(
        F.max("need").alias("need"), F.max(number("part_a")).alias("top_a"), F.max(number("part_b")).alias("top_b"),
        F.array_sort(F.collect_list(member)).alias("_m"))
    whole = (F.size("_m") == F.least(F.lit(width), F.col("n") - F.col("blk") * width)) & (
        F.element_at("_m", -1)["i"] - F.element_at("_m", 1)["i"] == F.size("_m") - 1)
    missing = F.raise_error(F.lit("a point that a lag leads to is not in the grid")).cast("array<struct<i:bigint,part_a:double,part_b:double>>")
    found = found.withColumn("_m", F.when(whole, F.col("_m")).otherwise(missing))
    return found.select("*", F.transform("_m", lambda m: m["part_a"]).alias("a"), F.transform("_m", lambda m: m["part_b"]).alias("b")).drop("_m")


def _reached(plan: SlidePlan, step: int, stride_s: float, width: int) -> Column:
    """The blocks of channel b that the lags of a span lead to from one block of channel a."""
    lags = span_lags(plan.n_lags, plan.step_s, stride_s) if plan.per_span else F.lit(plan.n_lags)
    n, last = F.col("n"), F.floor((F.col("n") - 1) / width)
    far = F.least(F.ceil(lags / 2) * step, n - 1)
    low = F.col("blk") * width - far
    high = F.least((F.col("blk") + 1) * width, n) - 1 + far
    run = lambda x, y: F.sequence(F.floor(x / width).cast("bigint"), F.floor(y / width).cast("bigint"))
    start = F.lit(0).cast("bigint")
    return (
        F.when(high - low + 1 >= n, F.sequence(start, last))
        .when(low < 0, F.array_distinct(F.concat(F.sequence(start, F.floor(high / width)), run(low + n, n - 1))))
        .when(high >= n, F.array_distinct(F.concat(run(low, n - 1), F.sequence(start, F.floor((high - n) / width)))))
        .otherwise(run(low, high))
    )


def pairs_above(rows: DataFrame, plan: SlidePlan, stride_s: float, half: int = 0, width: int = WIDTH) -> DataFrame:
    """The pairs of all lags of the plan with part_a + part_b > need: (span_start, lag_index, k, i, j).

    `rows` are (span_start, n, i, part_a, part_b, need), one per point; `need` is the same all over a span. NaN and NULL parts are in
    no pair. Only lags that a span can tell apart are taken where the plan says so, and none in a span no longer than a cluster. A
    missing point stops the query.
    """
    step = max(1, round(plan.step_s / stride_s))
    blocks = settle(_blocks(rows, width))
    a = blocks.select("span_start", "n", "blk", "need", "top_a", F.explode(_reached(plan, step, stride_s, width)).alias("q"))
    b = blocks.select("span_start", F.col("blk").alias("q"), "top_b", F.lit(True).alias("_there"))
    met = a.join(b, ["span_start", "q"], "left")
    gone = F.raise_error(F.lit("a point that a lag leads to is not in the grid")).cast("boolean")
    met = met.filter(F.coalesce("_there", gone)).filter(
        F.col("top_a") + F.col("top_b") > F.col("need") - _SLACK * (1 + F.abs("need")))
    full = met.select("span_start", "n", "blk", "q", "need").join(blocks.select("span_start", "blk", "a"), ["span_start", "blk"]).join(
        blocks.select("span_start", F.col("blk").alias("q"), "b"), ["span_start", "q"])
    n_lags, per_span, include_zero = plan.n_lags, plan.per_span, plan.include_zero

    def one(span: float, n: int, blk: int, q: int, need: float, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        most = min(n_lags, max(0, n // step - 1)) if per_span else n_lags
        need -= _SLACK * (1 + abs(need))
        found_i, found_j = np.nonzero(a[:, None] + b[None, :] > need)
        i, j = found_i + blk * width, found_j + q * width
        for around in (0, n, -n):
            k = i - j + around
            m = k // step
            index = np.where(m > 0, 2 * m - 1, -2 * m)
            on = (k % step == 0) & (np.abs(k) < n) & (index <= most) & (include_zero | (index > 0))
            if on.any() and n > 2 * half:
                yield np.full(int(on.sum()), span), index[on], k[on], i[on], j[on]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def handed_on() -> pa.RecordBatch:
            span, index, k, i, j = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array(span, pa.float64()), pa.array(index.astype(np.int32)), pa.array(k), pa.array(i), pa.array(j)],
                names=["span_start", "lag_index", "k", "i", "j"])

        for batch in batches:
            c = {name: batch.column(name) for name in ("span_start", "n", "blk", "q", "need", "a", "b")}
            for row in range(batch.num_rows):
                a, b = (c[x][row].values.to_numpy(zero_copy_only=False).astype(float) for x in ("a", "b"))
                for part in one(*(c[x][row].as_py() for x in ("span_start", "n", "blk", "q", "need")), a, b):
                    held.append(part)
                    count += len(part[0])
                    if count >= _BATCH:
                        yield handed_on()
                        held, count = [], 0
        if held:
            yield handed_on()

    return full.select("span_start", "n", "blk", "q", "need", "a", "b").mapInArrow(pairs, PAIRS)


#: Shares of the points at which the parts' distributions are read, ever finer towards the loud end.
_LEVELS = tuple(sorted({i / 40 for i in range(40)} | {1 - 10.0 ** -(i / 4) for i in range(4, 25)}))
#: How many more pairs than wanted the first floor aims at, and each lower one.
_AIM = 8


def _pairs_over(rows: DataFrame, plan: SlidePlan, stride_s: float) -> Callable[[float], float]:
    """Floor to expect so many pairs above, from the two parts' distributions as if they were independent."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    lags = span_lags(plan.n_lags, plan.step_s, stride_s) if plan.per_span else F.lit(plan.n_lags)
    row = rows.agg(F.sum(lags.cast("double")).alias("pairs"), *[
        F.percentile_approx(clean(c), [*_LEVELS, 1.0], 10_000).alias(c) for c in ("part_a", "part_b")]).first()
    if not row["pairs"] or row["part_a"] is None or row["part_b"] is None:
        return lambda n: -np.inf
    share = np.diff([*_LEVELS, 1.0])
    a, b = (np.array(row[c])[1:] for c in ("part_a", "part_b"))  # the upper end of each step, so that none is missed
    sums = (a[:, None] + b[None, :]).reshape(-1)
    order = np.argsort(-sums)
    expected = np.cumsum((share[:, None] * share[None, :]).reshape(-1)[order]) * row["pairs"]

    def floor(n: float) -> float:
        at = int(np.searchsorted(expected, n))
        return float(sums[order[at]]) if at < len(order) else -np.inf

    return floor


def loudest_slides(
    grid: DataFrame, plan: SlidePlan, stride_s: float, selection: Selection, stat: str, wanted: int, half: int = 0,
    a_cols: Sequence[str] = ("sigma_a",), b_cols: Sequence[str] = ("sigma_b",), width: int = WIDTH,
) -> DataFrame:
    """At least the `wanted` loudest rows of the selection over all slid pairs, every one above some floor; all rows if there are fewer.

    Pairs come in the order of their bounds: those above a floor are formed, selected and clustered within `half` points of
    their lag. A row above the floor is what it would be among all pairs, because whatever beats it is louder still. While there are
    too few such rows, the floor goes down.
    """
    if selection.parts is None:
        raise RefusedError("the selection states no bound of its statistic")
    parts = [with_slack(c.cast("double")).alias(f"part_{x}") for c, x in zip(selection.parts, "ab")]
    rows = settle(grid.select("span_start", "n", "i", *parts))
    floor_for = _pairs_over(rows, plan, stride_s)
    aim = float(_AIM * max(wanted, 1))
    while True:
        floor = floor_for(aim)
        pairs = settle(pairs_above(rows.withColumn("need", F.lit(floor)), plan, stride_s, half, width))
        formed = trigger_lookup(pairs, grid, a_cols, b_cols).select("span_start", "lag_index", "k", "i", "j", *a_cols, *b_cols)
        chosen = selection(formed)
        if "lag_index" not in chosen.columns:
            raise RefusedError("the selection dropped lag_index, so its results cannot be tied to the plan's livetime")
        if half:
            chosen = cluster_local_max(chosen, stat, half)
        if floor == -np.inf:
            return settle(chosen)
        sure = settle(chosen.filter(F.col(stat) > F.lit(floor)))
        if sure.limit(wanted).count() >= wanted:
            return sure
        aim *= _AIM
