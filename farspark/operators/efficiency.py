"""Detection efficiency with intervals, by bin, by definition, by model and over seeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from farspark.errors import RefusedError
from farspark.functions.expressions import (
    GLITCH_THRESHOLD,
    MASS_EDGES,
    SNR_EDGES,
    bin_index,
    channel_definitions,
    is_glitch,
    is_massive,
    passes,
    ratio,
    wilson_interval,
)
from farspark.operators.far import allowed_count, own_channel_threshold, resolvable_floor, thresholds_at_far
from farspark.operators.ordered import Cells, counts_at_least, percentiles
from farspark.operators.settle import settle


def _found(found) -> Column:
    return F.coalesce((F.col(found) if isinstance(found, str) else found), F.lit(False))


def efficiency(df: DataFrame, found="found", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows found, with its Wilson interval."""
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(_found(found), 1)).alias("n_found")
    )
    return counted.select("*", F.coalesce(ratio("n_found", "n_total"), F.lit(0.0)).alias("efficiency"),
                          *wilson_interval("n_found", "n_total"))


def efficiency_weighted(df: DataFrame, weight: str, found="found", by: Sequence[str] = ()) -> DataFrame:
    """Weighted share found; the interval uses the effective sample size (sum w)^2 / sum w^2."""
    w, hit = F.col(weight).cast("double"), _found(found)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(hit, 1)).alias("n_found"),
        F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"), F.sum(F.when(hit, w).otherwise(0.0)).alias("_wf"),
    )
    sums = sums.withColumn("efficiency", ratio("_wf", "_w")).withColumn(
        "n_eff", F.rint(ratio(F.col("_w") * F.col("_w"), "_ww")).cast("bigint")
    )
    k = F.rint(F.col("efficiency") * F.col("n_eff"))
    return sums.select(*by, "n_total", "n_found", "n_eff", "efficiency", *wilson_interval(k, "n_eff"))


def efficiency_at_far(
    foreground: DataFrame, background: DataFrame, stat: str, livetime_yr: float, targets: Sequence[float],
    trials: int = 4, by: Sequence[str] = (), weight: str | None = None, inclusive: bool = True,
) -> DataFrame:
    """Recovered share of the foreground at each target rate, thresholds set by the background."""
    by = list(by)
    thresholds = thresholds_at_far(background, stat, livetime_yr, targets, trials, by)
    judged = own_channel_threshold(foreground, thresholds, stat, by, targets, inclusive)
    keys = [*by, "far_per_yr", "threshold"]
    return efficiency_weighted(judged, weight, by=keys) if weight else efficiency(judged, by=keys)


def _bins(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    return df.sparkSession.createDataFrame(rows, "bin int, lo_edge double, hi_edge double")


def efficiency_vs(
    judged: DataFrame, parameter: str, edges: Sequence[float], found="found", by: Sequence[str] = (),
    keep_empty: bool = True,
) -> DataFrame:
    """Efficiency per half-open bin of a parameter, one threshold for all bins; empty bins are kept as NULL."""
    by = list(by)
    counted = (
        judged.withColumn("bin", bin_index(parameter, edges)).filter(F.col("bin").isNotNull())
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(_found(found), 1)).alias("n_found"))
    )
    frame = F.broadcast(_bins(judged, edges))  # one row per edge
    if keep_empty:
        if by:
            frame = counted.select(*by).distinct().crossJoin(frame)
        out = frame.join(counted, [*by, "bin"], "left").na.fill(0, ["n", "n_found"])
    else:
        out = counted.join(frame, "bin")
    return out.select(*by, "bin", "lo_edge", "hi_edge", "n", "n_found", ratio("n_found", "n").alias("efficiency"),
                      *wilson_interval("n_found", "n"))


def efficiency_vs_snr(judged: DataFrame, snr: str = "network_snr", found="found", by: Sequence[str] = ()) -> DataFrame:
    return efficiency_vs(judged, snr, SNR_EDGES, found, by, keep_empty=False)


def efficiency_vs_mass(
    judged: DataFrame, mass: str = "total_mass", found="found", by: Sequence[str] = (), edges=MASS_EDGES
) -> DataFrame:
    return efficiency_vs(judged, mass, edges, found, by)


def family_bin_rates(judged: DataFrame, parameter: str, edges: Sequence[float], **passed: Column) -> DataFrame:
    """Pass fraction of several yes/no columns per bin; an empty bin is an error, not a gap in a curve."""
    counted = (
        judged.withColumn("bin", bin_index(parameter, edges)).filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(_found(c).cast("double")).alias(k) for k, c in passed.items()])
    )
    out = F.broadcast(_bins(judged, edges)).join(counted, "bin", "left")
    filled = F.when(F.col("n").isNull(), F.raise_error(F.lit("a bin is empty"))).otherwise(F.col("n"))
    return out.withColumn("n", filled)


def gate_rates(hm="hm", lm="lm") -> dict[str, Column]:
    """Pass columns of the two specialists and of the gate they make together."""
    return {
        "hm_rate": passes(hm, GLITCH_THRESHOLD), "lm_rate": passes(lm, GLITCH_THRESHOLD),
        "gate_rate": ~is_glitch(hm, lm),
    }


def veto_rates(foreground: DataFrame) -> DataFrame:
    """Share of the foreground that reaches the strict channel, and the medians of what decides it."""
    medians = percentiles(foreground, "coherence", {"median_coherence": 0.5})
    medians = medians.crossJoin(percentiles(foreground, "centroid_a", {"median_centroid_a": 0.5}))  # one row each
    rate = foreground.agg(F.avg(is_massive("coherence", "centroid_a", "centroid_b").cast("double")).alias("strict_fraction"))
    return rate.crossJoin(medians)


def veto_ablation(
    background: DataFrame, foreground: DataFrame, stat: str, livetime_yr: float,
    targets: Sequence[float] = (100.0, 10.0, 1.0), trials: int = 4,
) -> DataFrame:
    """Four channel definitions on one trigger set: kept fractions, and efficiency at each target rate.

    Foreground counts only if it is in the channel and beats the channel's own threshold; the denominator is
    the whole foreground. Targets the livetime cannot resolve are left out.

    Membership is a bit mask: either side is read once, for its counts by mask and value, and all definitions and targets
    come from those. No row of the foreground meets a target.
    """
    definitions = list(channel_definitions())
    mask = reduce(add, [F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(channel_definitions().values())])
    nothing = F.lit(0).cast("bigint")

    def counted(df: DataFrame, n: Column, f: Column) -> DataFrame:
        return df.groupBy(mask.alias("_mask"), F.col(stat).cast("double").alias("stat")).agg(n.alias("n"), f.alias("f"))

    one = F.count(F.lit(1))
    sides = counted(background, one, F.first(nothing)).unionByName(counted(foreground, F.first(nothing), one))
    table = settle(sides.groupBy("_mask", "stat").agg(F.sum("n").alias("n"), F.sum("f").alias("f")))
    within = lambda i: F.col("_mask").bitwiseAND(1 << i) > 0
    share = lambda c: F.array(*[ratio(F.sum(F.when(within(i), F.col(c)).otherwise(0)), F.sum(c)) for i in range(len(definitions))])
    fractions = table.agg(share("n").alias("b"), share("f").alias("g"), F.sum("f").alias("_n")).select(
        F.posexplode(F.array(*[F.lit(d) for d in definitions])).alias("at", "definition"), "b", "g", "_n").select(
        "definition", F.get("b", F.col("at")).alias("background_fraction"), F.get("g", F.col("at")).alias("foreground_fraction"), "_n")  # a row per definition
    held = F.filter(F.array(*[F.when(within(i), F.lit(d)) for i, d in enumerate(definitions)]), lambda d: d.isNotNull())
    values = table.filter(F.col("stat").isNotNull() & ~F.isnan("stat")).select(F.explode(held).alias("definition"), "stat", "n", "f")
    values = values.groupBy("definition", "stat").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    ranked = counts_at_least(values, "stat", Cells.fit(background, stat), ["definition"], n_louder="n", f_upto="f")
    asked = [(float(t), allowed_count(t, livetime_yr, trials)) for t in targets if t >= resolvable_floor(livetime_yr, trials)]
    above, there = F.col("f_upto") - F.col("f"), F.when(F.col("n") > 0, F.col("stat"))
    cuts = []
    for far_per_yr, n in asked:
        at = F.when((F.col("n") > 0) & (F.col("n_louder") >= n), F.col("stat"))
        cuts.append(F.struct(
            F.lit(far_per_yr).alias("far_per_yr"), F.coalesce(F.max(at), F.min(there)).alias("threshold"), (F.lit(n) < F.sum("n")).alias("resolved"),
            F.coalesce(F.max_by(above, at), F.min_by(above, there)).alias("n_found")))
    cut = F.array(*cuts) if cuts else F.first(F.array().cast("array<struct<far_per_yr:double,threshold:double,resolved:boolean,n_found:bigint>>"))
    quoted = ranked.groupBy("definition").agg(cut.alias("c"), F.sum("n").alias("_b")).filter("_b > 0").select("definition", F.explode("c").alias("c")).select("definition", "c.*")
    return fractions.join(quoted, "definition", "left").select(
        "definition", "background_fraction", "foreground_fraction", "far_per_yr", "threshold", "resolved",
        ratio("n_found", "_n").alias("efficiency"))


def gate_kept(gated: DataFrame, stat: str, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Kept fraction and the gated floor per channel."""
    return gated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_gated"), F.count(F.when(F.col("kept"), 1)).alias("n_kept"),
        F.avg(F.col("kept").cast("double")).alias("kept_fraction"), F.min(stat).alias("floor"),
    )


def seed_summary(per_seed: DataFrame, value: str = "efficiency", by: Sequence[str] = ("far_per_yr",)) -> DataFrame:
    """Spread over seeds; the sample standard deviation is NULL for a single seed."""
    return per_seed.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).alias("sd"), F.count(value).alias("n_seeds"),
    )


def two_model_compare(
    foreground: DataFrame, background: DataFrame, stat: str, livetime_yr: float, far: float, snr: str, trials: int = 4,
    model: str = "model", channel: str = "channel", edges: Sequence[float] = SNR_EDGES,
) -> DataFrame:
    """Models side by side per bin, each judged by thresholds of its own background and its own channels."""
    thresholds = thresholds_at_far(background, stat, livetime_yr, [far], trials, [model, channel])
    judged = own_channel_threshold(foreground, thresholds, stat, [model, channel], [far], inclusive=False)
    return efficiency_vs(judged, snr, edges, by=[model], keep_empty=False)


def side_by_side(per_model: DataFrame, models: Sequence[str], model: str = "model") -> DataFrame:
    """The comparison as one row per bin; naming the models spares a pass that would discover them."""
    return per_model.groupBy("bin", "lo_edge", "hi_edge").pivot(model, list(models)).agg(
        F.first("n").alias("n"), F.first("efficiency").alias("efficiency")
    )


def matched_pairs(noise: DataFrame, signal: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Pair noise and signal rows by ordinal; the shorter side ends the pairing."""
    other = signal.select(row_id, *[F.col(c).alias(f"signal_{c}") for c in signal.columns if c != row_id])
    return noise.select(row_id, *[F.col(c).alias(f"noise_{c}") for c in noise.columns if c != row_id]).join(other, row_id)


def pair_counts(noise: DataFrame, signal: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Sizes of both sides and how many pair; `same_size` is the warning the pairing deserves."""
    n = noise.agg(F.count(F.lit(1)).alias("n_noise"))
    s = signal.agg(F.count(F.lit(1)).alias("n_signal"))
    p = matched_pairs(noise.select(row_id), signal.select(row_id), row_id).agg(F.count(F.lit(1)).alias("n_pairs"))
    return n.crossJoin(s).crossJoin(p).withColumn("same_size", F.col("n_noise") == F.col("n_signal"))


def require_foreground(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail before the long job when the foreground lacks a column the report needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise RefusedError(f"foreground is missing {', '.join(missing)}")
    return df

