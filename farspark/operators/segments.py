"""Segments: contiguous stretches of live time per channel (channel, start_s, end_s)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from farspark.errors import RefusedError
from farspark.operators.ordered import Cells, as_of, running
from farspark.operators.settle import settle


def duration() -> Column:
    return F.col("end_s") - F.col("start_s")


def total_livetime(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return segments.groupBy(*by).agg(F.sum(duration()).alias("livetime_s"))


def union_channels(*segments: DataFrame) -> DataFrame:
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return out


def available_segments(segments: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Segments whose data the catalogue holds."""
    return segments.join(catalogue.select("channel", "start_s", "end_s"), ["channel", "start_s", "end_s"], "left_semi")


def missing_segments(segments: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Wanted segments the catalogue does not hold, with the livetime that is lost."""
    keys = ["channel", "start_s", "end_s"]
    return segments.join(catalogue.select(*keys), keys, "left_anti").withColumn("livetime_s", duration())


def pair_spans(segments: DataFrame, channel_a: str, channel_b: str) -> DataFrame:
    """Spans observed by both channels, by exact bounds."""
    hit = segments.filter(F.col("channel").isin(channel_a, channel_b))
    both = hit.groupBy("start_s", "end_s").agg(
        F.max((F.col("channel") == channel_a).cast("int")).alias("a"),
        F.max((F.col("channel") == channel_b).cast("int")).alias("b"),
    )
    return both.filter((F.col("a") == 1) & (F.col("b") == 1)).select("start_s", "end_s")


def coincident_livetime(segments: DataFrame, channel_a: str, channel_b: str, cells: Cells | None = None) -> DataFrame:
    """Seconds during which both channels are live.

    A sweep, not an interval join: starts and ends become +1/-1 steps per channel, summed at equal times, and
    a running sum tells how many segments of each channel are open. Overlaps inside a channel count once.
    """
    hit = segments.filter(F.col("channel").isin(channel_a, channel_b) & (F.col("end_s") > F.col("start_s")))
    steps = hit.select(
        (F.col("channel") == channel_a).cast("int").alias("is_a"),
        F.explode(
            F.array(
                F.struct(F.col("start_s").alias("t"), F.lit(1).alias("d")),
                F.struct(F.col("end_s").alias("t"), F.lit(-1).alias("d")),
            )
        ).alias("e"),
    ).select(F.col("e.t").alias("t"), (F.col("e.d") * F.col("is_a")).alias("a"), (F.col("e.d") * (1 - F.col("is_a"))).alias("b"))
    times = steps.groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cells = cells or Cells.fit(steps, "t")
    opened = running(times, ["t"], {"open_a": ("sum", "a", True), "open_b": ("sum", "b", True)}, cells)
    after = (F.col("open_a") > 0) & (F.col("open_b") > 0)
    before = (F.col("open_a") > F.col("a")) & (F.col("open_b") > F.col("b"))
    # Where both become live time counts down, where they stop it counts up; seconds since the first step keep the digits.
    since = F.col("t") - F.lit(cells.splits[0] if cells.splits else 0.0)
    return opened.agg(F.coalesce(F.sum(
        F.when(before & ~after, since).when(after & ~before, -since)), F.lit(0.0)).alias("coincident_livetime_s"))


def numbered_starts(segments: DataFrame, cells: Cells | None = None) -> DataFrame:
    """One row per distinct start: (start_s, live, opens, grp, live_before), in one pass over ordered cells.

    `opens` is 1 where a block of overlapping time begins (touching is separate), `grp` numbers the blocks from 0, `live_before` is the
    livetime of all earlier blocks. Everything that runs over the whole order is carried from cell to cell by two small tables of
    cell totals: first the furthest end and the livetime, which settle where blocks open, then the blocks opened. A crowded start is one row.
    """
    cells = cells or Cells.fit(segments, "start_s")
    starts = segments.groupBy("start_s").agg(F.max("end_s").alias("reach"), F.sum(duration()).alias("live"))
    starts = settle(cells.attach(starts, "start_s"))
    inside = W.partitionBy("_cell").orderBy("start_s")
    earlier, so_far = (inside.rowsBetween(W.unboundedPreceding, end) for end in (-1, 0))
    cell_before = W.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # one row per cell
    totals = starts.groupBy("_cell").agg(F.max("reach").alias("r"), F.sum("live").alias("l"))
    carried = totals.select("_cell", F.max("r").over(cell_before).alias("_r"), F.coalesce(F.sum("l").over(cell_before), F.lit(0.0)).alias("_l"))
    seen = starts.join(carried, "_cell").withColumns({
        "_before": F.greatest(F.max("reach").over(earlier), "_r"), "_gone": F.coalesce(F.sum("live").over(earlier), F.lit(0.0)) + F.col("_l")})
    opens = F.when(F.col("_before").isNull() | (F.col("start_s") >= F.col("_before")), 1).otherwise(0).cast("bigint")
    opened = seen.select("_cell", "start_s", "live", opens.alias("opens"), F.when(opens == 1, F.col("_gone")).alias("_at"))
    totals = opened.groupBy("_cell").agg(F.sum("opens").alias("o"), F.max("_at").alias("a"))
    carried = totals.select("_cell", F.coalesce(F.sum("o").over(cell_before), F.lit(0)).alias("_o"), F.max("a").over(cell_before).alias("_a"))
    return settle(opened.join(carried, "_cell").select(
        "start_s", "live", "opens", (F.sum("opens").over(so_far) + F.col("_o") - 1).alias("grp"),
        F.greatest(F.max("_at").over(so_far), "_a").alias("live_before")))


def overlap_groups(segments: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Add `grp`, the 0-based number in time order of the maximal block of overlapping time; touching is separate.

    Works on distinct start times, so one crowded start is one row; segments that start together share a block.
    """
    return segments.join(numbered_starts(segments, cells).select("start_s", "grp"), "start_s")


def first_n_segments(segments: DataFrame, n: int) -> DataFrame:
    return segments.orderBy("start_s", "end_s", "channel").limit(n)


def completeness(samples: DataFrame, segments: DataFrame, rate: float) -> DataFrame:
    """Segments with their sample counts; `complete` is false where more than a second is missing or too much.

    `samples` holds one row per stored sample with its segment's channel, start_s and end_s.
    """
    keys = ["channel", "start_s", "end_s"]
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    return (
        segments.join(counts, keys, "left")
        .withColumn("n_samples", F.coalesce("n_samples", F.lit(0).cast("bigint")))
        .withColumn("expected", F.rint(duration() * rate).cast("bigint"))
        .withColumn("complete", F.abs(F.col("n_samples") - F.col("expected")) <= rate)
    )


def completeness_check(samples: DataFrame, segments: DataFrame, rate: float) -> DataFrame:
    """`completeness`, refusing segments that are not complete."""
    checked = settle(completeness(samples, segments, rate))
    bad = checked.filter(~F.col("complete")).limit(5).collect()
    if bad:
        names = ", ".join(f"{r.channel} {r.start_s:.0f}..{r.end_s:.0f} has {r.n_samples} of {r.expected}" for r in bad)
        raise RefusedError(f"incomplete segments: {names}")
    return checked


def livetime_quota(segments: DataFrame, n: int) -> DataFrame:
    """Rows per segment in proportion to livetime, at least one each."""
    total = segments.agg(F.sum(duration()).alias("_total"))  # one row
    share = F.rint(F.lit(float(n)) * duration() / F.col("_total")).cast("bigint")
    return segments.crossJoin(F.broadcast(total)).withColumn("quota", F.greatest(F.lit(1).cast("bigint"), share)).drop("_total")


def uniform(seed: int, *ids) -> Column:
    """A number in [0, 1) from row ids alone, so a draw does not depend on partitioning or retries."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def livetime_weighted_pick(
    draws: DataFrame, segments: DataFrame, window_s: float, draw_id: str = "draw_id", seed: int = 0
) -> DataFrame:
    """Place one window per draw: a segment in proportion to (livetime - window), then a uniform offset inside it."""
    usable = segments.filter(duration() > window_s).withColumn("_room", duration() - window_s)
    total = usable.agg(F.sum("_room")).first()[0]
    if total is None:
        raise RefusedError(f"no segment is longer than the {window_s} s window")
    cells = Cells.fit(usable, "start_s")
    laid = running(
        usable.withColumn("_tie", F.xxhash64("channel", "end_s")), ["start_s", "end_s", "channel", "_tie"],
        {"_from": ("sum", "_room", False)}, cells,
    ).select(F.coalesce("_from", F.lit(0.0)).alias("_from"), "channel", "start_s", "end_s", "_room")
    thrown = draws.withColumn("_u", uniform(seed, F.col(draw_id)) * F.lit(float(total)))
    placed = as_of(thrown, laid, "_u", "_from", ["channel", "start_s", "end_s", "_room"])
    start = F.col("start_s") + uniform(seed + 1, F.col(draw_id)) * F.col("_room")
    return placed.select(
        *draws.columns, "channel", F.col("start_s").alias("segment_start_s"), F.col("end_s").alias("segment_end_s"),
        start.alias("start_s"), (start + window_s).alias("end_s"),
    )
