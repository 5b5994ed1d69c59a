"""False-alarm rates, thresholds at a chosen rate, and top-k by channel."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from farspark.errors import RefusedError
from farspark.functions.expressions import far_rate, passes
from farspark.operators.ordered import (
    Cells,
    counts_at_least,
    group_sizes,
    percentiles,
    select_ranks,
    value_counts,
)
from farspark.operators.settle import settle


def _check_livetime(livetime_yr: float) -> None:
    if livetime_yr <= 0:
        raise ValueError("background livetime must be positive")


def resolvable_floor(livetime_yr: float, trials: int = 4) -> float:
    """The smallest rate a background of this length can show."""
    _check_livetime(livetime_yr)
    return trials / livetime_yr


def resolvable_targets(targets: DataFrame, livetime_yr: float, trials: int = 4) -> DataFrame:
    floor = resolvable_floor(livetime_yr, trials)
    return targets.withColumn("floor_per_yr", F.lit(floor)).filter(F.col("far_per_yr") >= F.lit(floor))


def allowed_count(far_per_yr: float, livetime_yr: float, trials: int) -> int:
    """Background events at or above a threshold of this rate; the order of operations fixes the rounding."""
    return max(math.floor(far_per_yr * livetime_yr / trials), 1)


def far_of(
    foreground: DataFrame, background: DataFrame, stat: str, livetime_yr: float, trials: int = 4,
    by: Sequence[str] = (), cells: Cells | None = None,
) -> DataFrame:
    """Add far_per_yr to each foreground row: trials times the background at or above it, per year, never zero.

    Counts are running sums down the distinct values of both sides; no foreground row meets a background row.
    """
    _check_livetime(livetime_yr)
    by = list(by)
    probes = value_counts(foreground, stat, by).select(*by, stat, F.lit(0).cast("bigint").alias("n"))
    both = value_counts(background, stat, by).unionByName(probes).groupBy(*by, stat).agg(F.sum("n").alias("n"))
    cells = cells or Cells.fit(background, stat, by)
    ranked = counts_at_least(both, stat, cells, by, n_louder="n")
    rates = ranked.select(*by, stat, "n_louder", far_rate("n_louder", livetime_yr, trials).alias("far_per_yr"))
    return lookup_values(foreground, rates, stat, by)


def ifar(far_per_yr) -> Column:
    c = F.col(far_per_yr) if isinstance(far_per_yr, str) else far_per_yr
    return F.lit(1.0) / c


# --- everything a report asks of a background, from one ordered table ------------------------


def rank_table(
    background: DataFrame, stat: str, by: Sequence[str] = (), cells: Cells | None = None, foreground: DataFrame | None = None,
) -> DataFrame:
    """(by..., stat, n, n_louder): distinct values with their background count and the background at or above them.

    Values of `foreground` are in it too, with n = 0 where the background has none. Two narrow passes over the background, after
    which thresholds, rates and extremes are aggregates of this table; it is written once.
    """
    by = list(by)
    counted = value_counts(background, stat, by)
    if foreground is not None:
        probes = value_counts(foreground, stat, by).select(*by, stat, F.lit(0).cast("bigint").alias("n"))
        counted = counted.unionByName(probes).groupBy(*by, stat).agg(F.sum("n").alias("n"))
    cells = cells or Cells.fit(background, stat, by)
    return settle(counts_at_least(counted, stat, cells, by, n_louder="n").select(*by, stat, "n", F.coalesce("n_louder", F.lit(0)).alias("n_louder")))


def _value_at(rank: int, stat: str) -> list[Column]:
    """Value of a rank counted from the loudest, the quietest where there are not so many, and the count at or above it."""
    at = F.when((F.col("n") > 0) & (F.col("n_louder") >= rank), F.col(stat).cast("double"))
    here = F.when((F.col("n") > 0) & (F.col("n_louder") >= rank), F.col("n_louder"))
    quietest = F.min(F.when(F.col("n") > 0, F.col(stat).cast("double")))
    return [F.coalesce(F.max(at), quietest), F.coalesce(F.min(here), F.sum("n"))]


def thresholds_from(
    table: DataFrame, stat: str, livetime_yr: float, targets: Sequence[float], trials: int = 4, by: Sequence[str] = (),
) -> DataFrame:
    """`thresholds_at_far` from a rank table, with `n_above`, the background at or above each threshold. Targets under the floor are left out."""
    floor = resolvable_floor(livetime_yr, trials)
    by = list(by)
    asked = [(float(t), allowed_count(t, livetime_yr, trials)) for t in targets if t >= floor]
    columns = []
    for i, (_, n) in enumerate(asked):
        value, above = _value_at(n, stat)
        columns += [value.alias(f"v{i}"), above.alias(f"a{i}")]
    wide = table.groupBy(*by).agg(F.sum("n").alias("n_background"), *columns).filter(F.col("n_background") > 0)
    rows = F.array(*[F.struct(
        F.lit(t).alias("far_per_yr"), F.lit(n).cast("bigint").alias("n_allowed"), F.col(f"v{i}").alias("threshold"), F.col(f"a{i}").alias("n_above"))
        for i, (t, n) in enumerate(asked)])
    if not asked:
        rows = F.array().cast("array<struct<far_per_yr:double,n_allowed:bigint,threshold:double,n_above:bigint>>")
    out = wide.select(*by, "n_background", F.explode(rows).alias("t"))
    return settle(out.select(
        *by, "t.far_per_yr", "t.n_allowed", "n_background", "t.threshold", (F.col("t.n_allowed") < F.col("n_background")).alias("resolved"), "t.n_above"))


def far_from(table: DataFrame, foreground: DataFrame, stat: str, livetime_yr: float, trials: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """`far_of` from a rank table that was made with this foreground; infinite in a group without background.

    A value that fills much of the foreground is looked up in a small table of such values, so it is not one task of the join.
    """
    by = list(by)
    rates = table.select(*by, stat, far_rate("n_louder", livetime_yr, trials).alias("far_per_yr"))
    measured = table.groupBy(*by).agg(F.sum("n").alias("_n_background"))
    out = lookup_values(foreground, rates, stat, by)
    out = out.join(measured, by, "left") if by else out.crossJoin(F.broadcast(measured))  # one row
    known = F.when(F.col("_n_background") > 0, F.col("far_per_yr")).otherwise(F.lit(float("inf")))
    return out.withColumn("far_per_yr", F.coalesce(known, F.lit(float("inf")))).drop("_n_background")


def lookup_values(rows: DataFrame, table: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """`rows` left-joined to a table of distinct values; values that fill whole quantiles of `rows` come from a broadcast of those few.

    At most some hundred values per group can be hot, whatever the size of either side.
    """
    by = list(by)
    hot = list(Cells.fit(rows, value).hot)
    if not hot:
        return rows.join(table, [*by, value], "left")
    is_hot = F.coalesce(F.col(value).cast("double").isin(*hot), F.lit(False))
    return rows.filter(~is_hot).join(table, [*by, value], "left").unionByName(
        rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), [*by, value], "left"))


def scanned_from(
    table: DataFrame, foreground: DataFrame, stat: str, livetime_yr: float, trials: int = 4, member: Column | None = None, steps: int = 8,
) -> DataFrame:
    """`scanned_ranks` from a rank table of one channel."""
    n = table.agg(F.sum("n")).first()[0] or 0
    ranks = geometric_ranks(n, steps)
    cuts = [F.struct(F.lit(r).cast("bigint").alias("n_louder"), _value_at(r, stat)[0].alias("threshold")) for r in ranks]
    empty = F.array().cast("array<struct<n_louder:bigint,threshold:double>>")
    cut = table.agg(F.array(*cuts).alias("c") if cuts else F.first(empty).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    beat = passes(stat, F.col("threshold"), inclusive=False) & (F.lit(True) if member is None else member)
    judged = foreground.crossJoin(F.broadcast(cut)).groupBy("n_louder", "threshold").agg(F.avg(beat.cast("double")).alias("efficiency"))  # at most `steps` cuts
    return judged.withColumn("far_per_yr", F.lit(float(trials)) * F.col("n_louder") / F.lit(float(livetime_yr)))


def loudest_from(table: DataFrame, stat: str, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(F.max(F.when(F.col("n") > 0, F.col(stat))).alias("loudest"), F.sum("n").alias("n"))


def thresholds_at_far(
    background: DataFrame, stat: str, livetime_yr: float, targets: Sequence[float], trials: int = 4,
    by: Sequence[str] = (), cells: Cells | None = None, below_floor: str = "raise",
) -> DataFrame:
    """Threshold of each channel for each target rate: (by..., far_per_yr, n_allowed, n_background, threshold, resolved).

    The threshold is the n-th loudest value. With n at or over the channel's size it is the smallest value,
    which is a floor and not a threshold, so `resolved` is false. A target below what the livetime resolves
    is an error, or left out with below_floor="drop".
    """
    floor = resolvable_floor(livetime_yr, trials)
    low = [t for t in targets if t < floor]
    if low and below_floor == "raise":
        raise RefusedError(
            f"a rate of {low[0]}/yr is below what {livetime_yr:.3g} yr of background can resolve ({floor:.3g}/yr)"
        )
    quoted = [(float(t), allowed_count(t, livetime_yr, trials)) for t in targets if t >= floor]
    by = list(by)
    cells = cells or Cells.fit(background, stat, by)
    if quoted:
        asked = F.array(*[
            F.struct(F.lit(t).alias("far_per_yr"), F.lit(n).cast("bigint").alias("n_allowed")) for t, n in quoted
        ])
    else:
        asked = F.array().cast("array<struct<far_per_yr:double,n_allowed:bigint>>")
    wanted = (
        group_sizes(background, stat, by)
        .filter(F.col("n") > 0)
        .select(*by, F.col("n").alias("n_background"), F.explode(asked).alias("t"))
        .select(*by, "n_background", "t.far_per_yr", "t.n_allowed")
        .withColumn("rank", F.least("n_allowed", "n_background"))
        .withColumn("resolved", F.col("n_allowed") < F.col("n_background"))
    )
    found = select_ranks(background, stat, wanted, cells, by)
    out = found.select(
        *by, "far_per_yr", "n_allowed", "n_background", F.col(stat).cast("double").alias("threshold"), "resolved"
    )
    return settle(out)  # one row per group and target, read by every report


def own_channel_threshold(
    foreground: DataFrame, thresholds: DataFrame, stat: str, by: Sequence[str] = ("channel",),
    far_targets: Sequence[float] | None = None, inclusive: bool = True,
) -> DataFrame:
    """Compare each foreground row with the threshold of its own channel, once per target.

    A channel without background has no threshold to beat: its threshold is infinite and nothing passes.
    """
    by = list(by)
    if far_targets is None:
        targets = F.broadcast(thresholds.select("far_per_yr").distinct())  # one row per target rate
        asked = foreground.crossJoin(targets)
    else:
        asked = foreground.withColumn("far_per_yr", F.explode(F.array(*[F.lit(float(t)) for t in far_targets])))
    out = asked.join(thresholds.select(*by, "far_per_yr", "threshold"), [*by, "far_per_yr"], "left")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))
    return out.withColumn("found", passes(stat, F.col("threshold"), inclusive))


def achieved_far(
    background: DataFrame, thresholds: DataFrame, stat: str, livetime_yr: float, trials: int = 4, by: Sequence[str] = ()
) -> DataFrame:
    """The rate each threshold really buys, beside its target."""
    by = list(by)
    cut = thresholds.select(*by, "far_per_yr", "threshold")  # one row per channel and target
    joined = background.join(cut, by) if by else background.crossJoin(F.broadcast(cut))
    counted = joined.groupBy(*by, "far_per_yr", "threshold").agg(
        F.count(F.when(passes(stat, F.col("threshold")), 1)).alias("n_above")
    )
    return counted.withColumn("achieved_far_per_yr", F.lit(float(trials)) * F.col("n_above") / F.lit(float(livetime_yr)))


def top_k_per_channel(
    triggers: DataFrame, stat: str, k: int, by: Sequence[str] = ("channel",), ties: Sequence[str] = (),
    cells: Cells | None = None,
) -> DataFrame:
    """The k loudest triggers of each channel, ties cut in the order of `ties`; `floor` is the smallest kept.

    The k-th value is selected first, and of the rows that share it each of a number of parts hands on at most k, so only some k rows of a
    channel ever reach the ranking window, however many are equal.
    """
    by = list(by)
    cells = cells or Cells.fit(triggers, stat, by)
    sized = group_sizes(triggers, stat, by).withColumn("rank", F.least(F.lit(k).cast("bigint"), F.col("n"))).drop("n")
    floors = select_ranks(triggers, stat, sized, cells, by).select(*by, F.col(stat).alias("floor"))
    loud = (triggers.join(floors, by) if by else triggers.crossJoin(F.broadcast(floors))).filter(
        F.col(stat) >= F.col("floor")
    )
    parts = max(1, int(triggers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    deal = F.pmod(F.xxhash64(*ties), F.lit(parts)) if ties else F.spark_partition_id()
    inside = W.partitionBy(*by, "_part").orderBy(*(ties or [F.lit(0)]))
    equal = loud.filter(F.col(stat) == F.col("floor")).withColumn("_part", deal)
    equal = equal.withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= k).drop("_part", "_rank")
    few = loud.filter(F.col(stat) > F.col("floor")).unionByName(equal)
    w = W.partitionBy(*by).orderBy(F.col(stat).desc(), *ties)
    return few.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def refuse_below_floor(thresholds: DataFrame, floors: DataFrame, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Add `quotable`: a threshold under the gated floor would count triggers nobody gated."""
    joined = thresholds.join(floors.select(*by, "floor"), list(by), "left")
    return joined.withColumn(
        "quotable", F.coalesce(F.col("resolved") & ~(F.col("threshold") < F.col("floor")), F.lit(False))
    )


def loudest(df: DataFrame, stat: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest statistic overall or per channel; NaN never wins."""
    clean = F.when(~F.isnan(F.col(stat)), F.col(stat))
    return df.groupBy(*by).agg(F.max(clean).alias("loudest"), F.count(clean).alias("n"))


def resolvable_ceiling(
    background: DataFrame, stat: str, livetime_yr: float, targets: Sequence[float], trials: int = 4,
    by: Sequence[str] = ("channel",),
) -> DataFrame:
    """Per channel the highest rate it can show, and whether each target lies between floor and ceiling."""
    floor = resolvable_floor(livetime_yr, trials)
    asked = F.array(*[
        F.struct(F.lit(float(t)).alias("far_per_yr"), F.lit(allowed_count(t, livetime_yr, trials)).cast("bigint").alias("n"))
        for t in targets
    ])
    sizes = group_sizes(background, stat, by).withColumnRenamed("n", "n_background")
    return sizes.select(
        *by, "n_background", (F.lit(float(trials)) * F.col("n_background") / livetime_yr).alias("ceiling_per_yr"),
        F.explode(asked).alias("t"),
    ).select(
        *by, "n_background", "ceiling_per_yr", "t.far_per_yr",
        ((F.col("t.far_per_yr") >= floor) & (F.col("t.n") < F.col("n_background"))).alias("resolvable"),
    )


def edge_point(
    background: DataFrame, foreground: DataFrame, stat: str, livetime_yr: float, trials: int = 4,
    by: Sequence[str] = ("seed",), member: Column | None = None,
) -> DataFrame:
    """Operate at the quietest surviving background trigger: its value, rate, and the efficiency above it."""
    by = list(by)
    clean = F.when(~F.isnan(F.col(stat)), F.col(stat))
    edge = background.groupBy(*by).agg(F.min(clean).alias("edge_stat"), F.count(clean).alias("n_background"))
    edge = edge.filter(F.col("n_background") > 0)
    beat = passes(stat, F.col("edge_stat"), inclusive=False) & (F.lit(True) if member is None else member)
    counted = foreground.join(edge, by).groupBy(*by, "edge_stat", "n_background").agg(
        F.count(F.lit(1)).alias("n_foreground"), F.avg(beat.cast("double")).alias("efficiency")
    )
    return counted.withColumn("far_per_yr", F.lit(float(trials)) * F.col("n_background") / livetime_yr)


def edge_range(edges: DataFrame) -> DataFrame:
    """Mean and range of the edge efficiency and rate over seeds."""
    span = lambda c: (F.max(c) - F.min(c)).alias(f"{c}_range")
    return edges.agg(
        F.avg("efficiency").alias("efficiency_mean"), span("efficiency"),
        F.avg("far_per_yr").alias("far_per_yr_mean"), span("far_per_yr"), F.count(F.lit(1)).alias("n_seeds"),
    )


def efficiency_vs_achieved_far(
    background: DataFrame, foreground: DataFrame, stat: str, livetime_yr: float, trials: int = 4,
    member: Column | None = None, by: Sequence[str] = (), cells: Cells | None = None,
) -> DataFrame:
    """At every background value, loudest first: the rate there and the share of the foreground strictly above.

    Both sides are counted down one ordered table of distinct values. Foreground outside the channel
    (`member` false) stays in the denominator.
    """
    _check_livetime(livetime_yr)
    by = list(by)
    member = F.lit(True) if member is None else member
    bg = value_counts(background, stat, by).select(*by, stat, "n", F.lit(0).cast("bigint").alias("f"))
    fg = value_counts(foreground.filter(member), stat, by).select(
        *by, stat, F.lit(0).cast("bigint").alias("n"), F.col("n").alias("f")
    )
    total = foreground.groupBy(*by).agg(F.count(F.lit(1)).alias("n_foreground"))
    both = bg.unionByName(fg).groupBy(*by, stat).agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    cells = cells or Cells.fit(background, stat, by)
    ranked = counts_at_least(both, stat, cells, by, n_louder="n", f_upto="f").filter(F.col("n") > 0)
    ranked = ranked.join(total, by) if by else ranked.crossJoin(F.broadcast(total))
    return ranked.select(
        *by, F.col(stat).alias("threshold"), F.col("n").alias("n_equal"), "n_louder",
        far_rate("n_louder", livetime_yr, trials).alias("far_per_yr"),
        ((F.col("f_upto") - F.col("f")) / F.col("n_foreground").cast("double")).alias("efficiency"),
    )


def geometric_ranks(n: int, steps: int = 8) -> list[int]:
    """Distinct whole ranks 1..n at equal ratios."""
    top = max(n, 2)
    return sorted({min(max(round(top ** (i / (steps - 1))), 1), n) for i in range(steps)}) if n else []


def scanned_ranks(
    background: DataFrame, foreground: DataFrame, stat: str, livetime_yr: float, trials: int = 4,
    member: Column | None = None, steps: int = 8, cells: Cells | None = None,
) -> DataFrame:
    """The achieved-rate curve at a few geometric ranks: a table of at most `steps` rows."""
    spark = background.sparkSession
    cells = cells or Cells.fit(background, stat)
    ranks = spark.createDataFrame([(r,) for r in geometric_ranks(cells.rows, steps)], "rank bigint")
    cut = select_ranks(background, stat, ranks, cells).select("rank", F.col(stat).cast("double").alias("threshold"))
    beat = passes(stat, F.col("threshold"), inclusive=False) & (F.lit(True) if member is None else member)
    return (
        foreground.crossJoin(F.broadcast(cut))
        .groupBy("rank", "threshold")
        .agg(F.avg(beat.cast("double")).alias("efficiency"))
        .withColumn("far_per_yr", F.lit(float(trials)) * F.col("rank") / F.lit(float(livetime_yr)))
        .withColumnRenamed("rank", "n_louder")
    )


def injection_far_quantiles(rated: DataFrame, band: str, far: str = "far_per_yr") -> DataFrame:
    """Median and best rate reached by the foreground, per band; an infinite rate is a channel with no background."""
    rated = rated.filter(F.col(band).isNotNull())
    median = percentiles(rated, far, {"median_far": 0.5}, [band])
    best = rated.groupBy(band).agg(F.min(far).alias("best_far"), F.count(F.lit(1)).alias("n"))
    return best.join(median, band, "left")
