"""Sensitive volume: Euclidean and comoving, with counting errors, ratios and spread over seeds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from farspark.errors import RefusedError
from farspark.functions.expressions import passes, ratio, sensitive_distance_mpc
from farspark.operators.far import own_channel_threshold, thresholds_at_far
from farspark.operators.ordered import Cells, as_of, select_ranks
from farspark.operators.settle import settle

SPEED_OF_LIGHT_KM_S = 299792.458


def volume_of(
    judged: DataFrame, v_generated_gpc3: float, analysis_time_yr: float | None = None, weight: str | None = None,
    found: str = "found", by: Sequence[str] = (),
) -> DataFrame:
    """Monte-Carlo volume from a found column: generated volume times the weighted share found.

    The variance needs no second pass: for a 0/1 column, sum w^2 (f - p)^2 splits into the squared weights of
    the found and of the missed.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    hit = F.coalesce(F.col(found), F.lit(False))
    s = judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_injections"), F.count(F.when(hit, 1)).alias("n_found"), F.sum(w).alias("_w"),
        F.sum(F.when(hit, w).otherwise(0.0)).alias("_wf"), F.sum(F.when(hit, w * w).otherwise(0.0)).alias("_wwf"),
        F.sum(F.when(hit, 0.0).otherwise(w * w)).alias("_wwm"),
    )
    p = ratio("_wf", "_w")
    variance = ratio(F.col("_wwf") * (1.0 - p) * (1.0 - p) + F.col("_wwm") * p * p, F.col("_w") * F.col("_w"))
    v = F.lit(float(v_generated_gpc3))
    empty = F.raise_error(F.lit("empty injection campaign"))
    out = s.select(
        *by, F.when(F.col("n_injections") == 0, empty).otherwise(F.col("n_injections")).alias("n_injections"), "n_found",
        (v * p).alias("v_sens_gpc3"), (v * F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("v_sens_err_gpc3"),
    ).withColumn(
        "horizon_mpc",
        F.when(F.col("v_sens_gpc3") > 0, sensitive_distance_mpc("v_sens_gpc3")).otherwise(F.lit(0.0)),
    )
    time = F.lit(None).cast("double") if analysis_time_yr is None else F.lit(float(analysis_time_yr))
    return out.withColumn("vt_gpc3_yr", F.col("v_sens_gpc3") * time)


def sensitive_volume(
    foreground: DataFrame, background: DataFrame, stat: str, livetime_yr: float, targets: Sequence[float],
    v_generated_gpc3: float, analysis_time_yr: float | None = None, trials: int = 4, weight: str | None = None,
    by: Sequence[str] = (), inclusive: bool = True,
) -> DataFrame:
    thresholds = thresholds_at_far(background, stat, livetime_yr, targets, trials, by)
    judged = own_channel_threshold(foreground, thresholds, stat, by, targets, inclusive)
    return volume_of(judged, v_generated_gpc3, analysis_time_yr, weight, by=[*by, "far_per_yr", "threshold"])


def vt_ratio(
    candidate: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("far_per_yr",), zero_baseline: str = "raise"
) -> DataFrame:
    """Volume ratio of two results on a shared campaign; relative errors add in quadrature.

    A zero baseline stops the query, or gives NULLs with zero_baseline="null".
    """
    c, b = (
        df.select(*keys, F.col("v_sens_gpc3").alias(f"{p}_v"), F.col("v_sens_err_gpc3").alias(f"{p}_e"))
        for df, p in ((candidate, "c"), (baseline, "b"))
    )
    zero = F.lit(None) if zero_baseline == "null" else F.raise_error(F.lit("baseline sensitive volume is zero"))
    base = F.when(F.col("b_v") <= 0, zero.cast("double")).otherwise(F.col("b_v"))
    r = F.col("c_v") / base
    rel = F.hypot(F.coalesce(ratio("c_e", "c_v"), F.lit(0.0)), F.col("b_e") / base)
    return c.join(b, list(keys)).select(*keys, r.alias("ratio"), (r * rel).alias("ratio_err"))


# --- comoving weights -----------------------------------------------------------------------


def cosmology_grid(
    spark: SparkSession, h0: float = 67.66, omega_m: float = 0.30966, z_max: float = 3.0, n_grid: int = 4000
) -> DataFrame:
    """Flat Lambda-CDM on an even redshift grid: (z, d_l_mpc, weight).

    The weight turns a campaign drawn evenly in Euclidean volume into comoving volume seen by an observer:
    (dVc/dVe)/(1+z). The grid has a fixed number of rows, so its windows may sit in one partition.
    """
    z0 = 1e-6
    dz = (z_max - z0) / (n_grid - 1)
    hubble = SPEED_OF_LIGHT_KM_S / h0
    w = W.partitionBy(F.lit(0)).orderBy("node")
    inv_e = lambda z: 1.0 / F.sqrt(omega_m * F.pow(1.0 + z, F.lit(3.0)) + (1.0 - omega_m))
    g = spark.range(n_grid).select(F.col("id").alias("node"), (F.lit(z0) + F.col("id") * F.lit(dz)).alias("z"))
    g = g.withColumn("ie", inv_e(F.col("z")))
    # Simpson's rule inside each cell: the integrand at the cell's middle is as cheap as at its ends.
    step = F.lit(dz / 6.0) * (F.lag("ie").over(w) + 4.0 * inv_e(F.col("z") - dz / 2.0) + F.col("ie"))
    first = F.lit(z0) * (1.0 + F.col("ie")) / 2.0
    g = g.withColumn("step", F.when(F.col("node") == 0, first).otherwise(step))
    g = g.withColumn("d_c", F.lit(hubble) * F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = g.withColumn("d_l_mpc", (1.0 + F.col("z")) * F.col("d_c"))
    ahead, behind = F.lead("d_l_mpc").over(w), F.lag("d_l_mpc").over(w)
    slope = (
        F.when(behind.isNull(), (ahead - F.col("d_l_mpc")) / dz)
        .when(ahead.isNull(), (F.col("d_l_mpc") - behind) / dz)
        .otherwise((ahead - behind) / (2.0 * dz))
    )
    dvc = 4.0 * math.pi * hubble * F.col("d_c") * F.col("d_c") * F.col("ie")
    dve = 4.0 * math.pi * F.col("d_l_mpc") * F.col("d_l_mpc") * slope
    return g.select("z", "d_l_mpc", (dvc / dve / (1.0 + F.col("z"))).alias("weight"))


def _with_successor(grid: DataFrame, node: str, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Each node with the node after it: inside its cell by a window, from the last of a cell by the first of the next."""
    here = F.struct(F.col(node).alias("x"), *[F.col(v).alias(v) for v in values])
    placed = Cells.fit(grid, node).attach(grid.select(*by, node, *values), node)
    ahead = F.lead(here).over(W.partitionBy(*by, "_cell").orderBy(node))
    firsts = placed.groupBy(*by, "_cell").agg(F.min(here).alias("_first"))
    onward = firsts.select(*by, "_cell", F.lead("_first").over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_cell")).alias("_next"))  # one row per cell
    return placed.withColumn("_ahead", ahead).join(onward, [*by, "_cell"]).select(
        *by, F.col(node).alias("_x0"), *[F.col(v).alias(f"_y0_{v}") for v in values], F.coalesce("_ahead", "_next").alias("_to"))


def grid_interpolate(
    df: DataFrame, x: str, grid: DataFrame, node: str, values: Sequence[str], by: Sequence[str] = (), beyond: str = "raise",
) -> DataFrame:
    """Linear interpolation of grid values at x, clamped below the first node.

    A value past the last node stops the query, or is NULL with beyond="null". NULL, and any value where there are no nodes, gives NULL.
    """
    by = list(by)
    cells = _with_successor(grid, node, values, by)
    lowest = F.struct(F.col(node).alias("x"), *[F.col(v).alias(v) for v in values])
    low = grid.groupBy(*by).agg(F.min(lowest).alias("_low"))
    out = as_of(df, cells, x, "_x0", ["_x0", "_to", *[f"_y0_{v}" for v in values]], by)
    out = out.join(low, by, "left") if by else out.crossJoin(F.broadcast(low))  # one row
    past = F.col("_to").isNull() & (F.col(x) > F.col("_x0"))
    outside = F.lit(None).cast("double") if beyond == "null" else F.raise_error(F.lit("value is past the last grid node")).cast("double")
    t = F.coalesce((F.col(x) - F.col("_x0")) / (F.col("_to.x") - F.col("_x0")), F.lit(0.0))
    for v in values:
        inside = F.col(f"_y0_{v}") + t * (F.coalesce(F.col(f"_to.{v}"), F.col(f"_y0_{v}")) - F.col(f"_y0_{v}"))
        y = F.when(F.col(x) < F.col("_low.x"), F.col(f"_low.{v}")).otherwise(inside)
        out = out.withColumn(f"_out_{v}", F.when(past, outside).otherwise(y))
    return out.select(*df.columns, *[F.col(f"_out_{v}").alias(v) for v in values])


def comoving_weight(df: DataFrame, distance: str = "distance_mpc", **cosmology) -> DataFrame:
    """Add z and weight at each luminosity distance."""
    return grid_interpolate(df, distance, cosmology_grid(df.sparkSession, **cosmology), "d_l_mpc", ["z", "weight"])


def euclidean_volume_gpc3(distance_max_mpc) -> Column:
    d = F.col(distance_max_mpc) if isinstance(distance_max_mpc, str) else F.lit(float(distance_max_mpc))
    return F.lit(4.0 / 3.0 * math.pi) * F.pow(d / 1000.0, F.lit(3.0))


def comoving_volume(
    judged: DataFrame, distance_max_mpc: float, n_attempted: int, weight: str = "weight", found: str = "found",
    by: Sequence[str] = (),
) -> DataFrame:
    """Euclidean and comoving volume of what was found; what failed to generate was not found and stays counted."""
    hit = F.coalesce(F.col(found), F.lit(False))
    v = euclidean_volume_gpc3(distance_max_mpc)
    n = F.lit(float(n_attempted))
    return judged.groupBy(*by).agg(
        F.count(F.when(hit, 1)).alias("n_found"),
        (v * F.count(F.when(hit, 1)) / n).alias("v_euclid_gpc3"),
        (v * F.sum(F.when(hit, F.col(weight)).otherwise(0.0)) / n).alias("v_comoving_gpc3"),
    )


def volume_rank_error(
    foreground: DataFrame, background: DataFrame, stat: str, thresholds: DataFrame, distance_max_mpc: float,
    n_attempted: int, weight: str = "weight", by: Sequence[str] = (), cells: Cells | None = None,
) -> DataFrame:
    """Volume at each threshold and at background ranks k - sqrt(k) and k + sqrt(k), k the count at the threshold."""
    by = list(by)
    cells = cells or Cells.fit(background, stat, by)
    cut = thresholds.select(*by, "far_per_yr", "threshold")  # one row per target (and group)
    at_or_above = background.join(cut, by) if by else background.crossJoin(F.broadcast(cut))
    k = at_or_above.groupBy(*by, "far_per_yr", "threshold").agg(
        F.count(F.when(passes(stat, F.col("threshold")), 1)).alias("k"), F.count(F.lit(1)).alias("n")
    )
    k = settle(k)
    root = F.sqrt(F.col("k").cast("double"))
    ends = k.select("*", F.explode(F.array(
        F.struct(F.lit("tight").alias("end"), F.greatest(F.lit(1), F.rint(F.col("k") - root)).cast("bigint").alias("rank")),
        F.struct(F.lit("loose").alias("end"), F.least(F.col("n"), F.rint(F.col("k") + root).cast("bigint")).alias("rank")),
    )).alias("e")).select(*by, "far_per_yr", "threshold", "k", "e.end", "e.rank")
    moved = select_ranks(background, stat, ends, cells, by)
    cuts = moved.select(*by, "far_per_yr", "k", "end", F.col(stat).cast("double").alias("cut")).unionByName(
        k.select(*by, "far_per_yr", "k", F.lit("at").alias("end"), F.col("threshold").alias("cut"))
    )
    judged = (foreground.join(cuts, by) if by else foreground.crossJoin(F.broadcast(cuts))).withColumn(
        "found", passes(stat, F.col("cut"), inclusive=False)
    )
    v = comoving_volume(judged, distance_max_mpc, n_attempted, weight, by=[*by, "far_per_yr", "k", "end"])
    at = lambda c, e: F.max(F.when(F.col("end") == e, F.col(c)))
    moved_only = F.when(F.col("end") != "at", F.col("v_comoving_gpc3"))
    return v.groupBy(*by, "far_per_yr", "k").agg(
        at("n_found", "at").alias("n_found"), at("v_euclid_gpc3", "at").alias("v_euclid_gpc3"),
        at("v_comoving_gpc3", "at").alias("v_comoving_gpc3"), F.min(moved_only).alias("v_low_gpc3"),
        F.max(moved_only).alias("v_high_gpc3"),
    ).select(
        "*", (1.0 / F.sqrt(F.greatest(F.col("n_found"), F.lit(1)).cast("double"))).alias("rel_error_found"),
        (1.0 / F.sqrt(F.greatest(F.col("k"), F.lit(1)).cast("double"))).alias("rel_error_background"),
    ).withColumnRenamed("k", "n_background_above")


def volume_over_seeds(per_seed: DataFrame) -> DataFrame:
    """Mean volume and its range over seeds per target; targets no seed resolved have no row."""
    return per_seed.groupBy("far_per_yr").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.floor(F.avg("n_found")).alias("n_found_mean"),
        F.floor(F.avg("n_background_above")).alias("n_background_above"),
        F.avg("v_comoving_gpc3").alias("v_comoving_mean"), F.min("v_comoving_gpc3").alias("v_comoving_min"),
        F.max("v_comoving_gpc3").alias("v_comoving_max"), F.avg("v_low_gpc3").alias("v_low_mean"),
        F.avg("v_high_gpc3").alias("v_high_mean"), F.avg("v_euclid_gpc3").alias("v_euclid_mean"),
        F.avg("rel_error_found").alias("rel_error_found"), F.avg("rel_error_background").alias("rel_error_background"),
    )


def require_volumetric(df: DataFrame) -> DataFrame:
    if "distance_mpc" not in df.columns:
        raise RefusedError("not a volumetric campaign: no distance_mpc")
    return df
