"""Calibration of probabilities, and the score diagnostics that need no false-alarm rate."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from farspark.functions.arrays import array_mean, array_std, fraction_above
from farspark.functions.expressions import FRONT_END_SNR_EDGES, bin_index, passes, ratio
from farspark.operators.efficiency import efficiency_vs
from farspark.operators.ordered import Cells, ordinal, percentiles


def _edges(n_bins: int) -> list[float]:
    return [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)]


def _calibration_bins(df: DataFrame, p: str, y: str, n_bins: int) -> DataFrame:
    return (
        df.withColumn("bin", bin_index(p, _edges(n_bins), clamp_last=True))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    )


def ece(df: DataFrame, p: str = "p", y: str = "y", n_bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    gap = F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))
    return _calibration_bins(df, p, y, n_bins).agg(ratio(F.sum(gap), F.sum("n")).alias("ece"))


def reliability_curve(df: DataFrame, p: str = "p", y: str = "y", n_bins: int = 15) -> DataFrame:
    """Mean prediction, observed frequency and count of every bin, empty ones included."""
    frame = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(frame).join(_calibration_bins(df, p, y, n_bins), "bin", "left")  # n_bins rows
    return out.na.fill(0, ["n"])


class _Gradient:
    """d(loss)/d(log T) on an interval of log T, from its values at Chebyshev nodes.

    The gradient is analytic in log T with its nearest singularity pi/2 off the real axis whatever the data,
    so 64 nodes on an interval of half-width 2.5 reproduce it to rounding. One scan gives all the nodes, where
    a plain descent would scan once per step.
    """

    HALF, NODES = 2.5, 64

    def __init__(self, table: DataFrame, centre: float):
        self.centre = centre
        theta = (np.arange(self.NODES) + 0.5) * np.pi / self.NODES
        self.nodes = np.cos(theta)
        self.weights = (-1.0) ** np.arange(self.NODES) * np.sin(theta)
        terms = []
        for u in self.nodes:
            t = math.exp(centre + self.HALF * float(u))
            x = F.col("z") / F.lit(t)
            terms.append(F.sum((F.lit(1.0) / (F.lit(1.0) + F.exp(-x)) - F.col("y")) * (-x) * F.col("n")))
        row = table.agg(F.sum("n").alias("n"), *[t.alias(f"g{i}") for i, t in enumerate(terms)]).first()
        if not row["n"]:
            raise ValueError("no rows to fit a temperature on")
        self.values = np.array([row[f"g{i}"] for i in range(self.NODES)], dtype=float) / row["n"]

    def covers(self, log_t: float) -> bool:
        return abs(log_t - self.centre) <= self.HALF

    def __call__(self, log_t: float) -> float:
        gap = (log_t - self.centre) / self.HALF - self.nodes
        if (np.abs(gap) < 1e-15).any():
            return float(self.values[np.argmin(np.abs(gap))])
        c = self.weights / gap
        return float((c @ self.values) / c.sum())


def fit_temperature(df: DataFrame, z: str = "z", y: str = "y", max_iter: int = 200, lr: float = 0.05) -> float:
    """Temperature minimising the log loss of sigmoid(z/T), by gradient descent on log T from T = 1."""
    table = (
        df.select(F.col(z).cast("double").alias("z"), F.col(y).cast("double").alias("y"))
        .groupBy("z", "y").agg(F.count(F.lit(1)).alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        log_t, gradient = 0.0, _Gradient(table, 0.0)
        for _ in range(max_iter):
            if not gradient.covers(log_t):
                gradient = _Gradient(table, log_t)
            step = gradient(log_t)
            log_t -= lr * step
            if abs(step) < 1e-9:
                break
        return math.exp(log_t)
    finally:
        table.unpersist()


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Add `weight` = N / (classes * class size)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    weights = counts.crossJoin(F.broadcast(whole)).select(  # one row
        label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight")
    )
    return df.join(weights, label)


def score_summary(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    moments = df.groupBy(*by).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n")
    )
    p99 = percentiles(df, score, {"p99": 0.99}, by)
    return moments.join(p99, list(by)) if by else moments.crossJoin(p99)  # one row


def _noise_moments(df: DataFrame, score: str, is_signal: Column) -> DataFrame:
    noise, signal = F.when(~is_signal, F.col(score)), F.when(is_signal, F.col(score))
    return df.agg(
        F.avg(noise).alias("noise_mean"), F.stddev_pop(noise).alias("noise_std"), F.avg(signal).alias("signal_mean"),
        F.count(noise).alias("n_noise"), F.count(signal).alias("n_signal"),
    )


def count_above_3sigma(df: DataFrame, score: str, is_signal: Column) -> DataFrame:
    """Signals above noise mean + 3 sd, with the smooth tie-break that makes a selection value."""
    m = _noise_moments(df, score, is_signal).withColumn("threshold", F.col("noise_mean") + 3.0 * F.col("noise_std"))
    above = df.crossJoin(F.broadcast(m.select("threshold"))).agg(  # one row
        F.count(F.when(is_signal & passes(score, F.col("threshold"), inclusive=False), 1)).alias("n_above")
    )
    separation = F.col("signal_mean") - F.col("noise_mean")
    frac = 0.5 * (1.0 + F.tanh(separation / (F.col("noise_std") + 1e-12)))
    return m.crossJoin(above).select(
        "threshold", "n_above", "n_signal", separation.alias("separation"), frac.alias("tie_break"),
        (-(F.col("n_above") + frac)).alias("selection_value"),
    )


def noise_thresholds(df: DataFrame, score: str, is_signal: Column) -> DataFrame:
    """Three thresholds set by the noise alone: (threshold_name, threshold)."""
    noise = df.filter(~is_signal)
    q = percentiles(noise, score, {"noise_p99": 0.99, "noise_p999": 0.999})
    s = noise.agg((F.avg(score) + 3.0 * F.stddev_pop(score)).alias("3sigma"))
    return s.crossJoin(q).unpivot([], ["3sigma", "noise_p99", "noise_p999"], "threshold_name", "threshold")


def efficiency_at_quantile(df: DataFrame, score: str, is_signal: Column) -> DataFrame:
    """Signals above each noise threshold, and the noise quantile the threshold really sits at."""
    cut = F.broadcast(noise_thresholds(df, score, is_signal))  # three rows
    hit = passes(score, F.col("threshold"), inclusive=False).cast("double")
    under = F.coalesce(F.col(score) <= F.col("threshold"), F.lit(False)).cast("double")
    return df.crossJoin(cut).groupBy("threshold_name", "threshold").agg(
        F.avg(F.when(is_signal, hit)).alias("efficiency"), F.avg(F.when(~is_signal, under)).alias("noise_quantile")
    )


def efficiency_vs_snr_at_quantile(
    df: DataFrame, score: str, is_signal: Column, snr: str, name: str = "noise_p999", edges=FRONT_END_SNR_EDGES
) -> DataFrame:
    cut = F.broadcast(noise_thresholds(df, score, is_signal).filter(F.col("threshold_name") == name))  # one row
    judged = df.filter(is_signal).crossJoin(cut)
    return efficiency_vs(judged, snr, edges, passes(score, F.col("threshold"), inclusive=False))


def shape_stats(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Median, tail percentiles, maximum, skewness and excess kurtosis of the standardised score."""
    by = list(by)
    m = df.groupBy(*by).agg(
        F.avg(score).alias("_mu"), F.stddev_pop(score).alias("_sd"), F.max(score).alias("_max"),
        F.skewness(score).alias("skewness"), F.kurtosis(score).alias("excess_kurtosis"),
    )
    q = percentiles(df, score, {"_p50": 0.5, "_p99": 0.99, "_p999": 0.999}, by)
    z = lambda c: ratio(F.col(c) - F.col("_mu"), "_sd")
    return (m.join(q, by) if by else m.crossJoin(q)).select(
        *by, z("_p50").alias("median"), z("_p99").alias("p99"), z("_p999").alias("p999"), z("_max").alias("maximum"),
        "skewness", "excess_kurtosis",
    )


def spearman(df: DataFrame, x: str, y: str, row_id: str, cell_rows: int | None = None) -> DataFrame:
    """Rank correlation with ordinal ranks; equal values are ranked in the order of `row_id`."""
    d = df.select(row_id, x, y)
    ids = Cells.fit(d, row_id, cell_rows=cell_rows)
    for c, r in ((x, "_rx"), (y, "_ry")):
        d = ordinal(d, [c, row_id], Cells.fit(df, c, cell_rows=cell_rows), r, tie_cells=ids)
    return d.agg(F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double")).alias("spearman"))


def tile_properties(df: DataFrame, data: str = "data") -> DataFrame:
    """Add mean, population standard deviation and share above one half of each array."""
    return df.select(
        "*", array_mean(data).alias("tile_mean"), array_std(data).alias("tile_std"),
        fraction_above(data, 0.5).alias("tile_fraction"),
    )


def separation(df: DataFrame, score: str, is_signal: Column) -> DataFrame:
    m = _noise_moments(df, score, is_signal)
    return m.select(((F.col("signal_mean") - F.col("noise_mean")) / (F.col("noise_std") + 1e-12)).alias("separation"))


def margin_loss(df: DataFrame, error: str, is_signal: Column, margin: float = 3.0, lam: float = 2.0) -> DataFrame:
    """Noise error plus a hinge on the class means; evaluation only."""
    m = _noise_moments(df, error, is_signal)
    hinge = F.greatest(F.lit(0.0), margin * F.col("noise_mean") - F.col("signal_mean"))
    return m.select(
        F.col("noise_mean").alias("noise"), F.col("signal_mean").alias("signal"), hinge.alias("margin"),
        (F.col("noise_mean") + lam * hinge).alias("total"),
    )


def ensemble_spread(members: DataFrame, row_id: Sequence[str], score: str = "score") -> DataFrame:
    """Mean and population spread of the members' scores per row."""
    return members.groupBy(*row_id).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("spread"), F.count(score).alias("n_members")
    )
