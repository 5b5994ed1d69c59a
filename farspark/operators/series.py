"""Jobs over array-valued series: window grids, PSD preparation, network sums, cropped magnitudes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from farspark.functions import kernels
from farspark.functions.arrays import band_crops, rescale
from farspark.functions.expressions import HIGH_MASS_BAND_HZ, LOW_MASS_BAND_HZ, column_for
from farspark.operators.ordered import percentiles


def window_grid(
    chunks: DataFrame, fs: float, window_s: float, stride_s: float, keys: Sequence[str] = ("channel", "span_start"),
    position: str = "first_sample", data: str = "data", samples: str = "n_samples",
) -> DataFrame:
    """Overlapping windows of a span: (keys, i, t_centre, window), i counting from 0; the last full window is left out.

    A span arrives as chunks (first sample number, samples array, length of the whole span), so no task needs
    all of it: each chunk is cut into pieces for the windows that touch it, and a window is its pieces in order.
    A window whose pieces do not add up keeps its place in the grid as zeros.
    """
    n, step = int(round(window_s * fs)), int(round(stride_s * fs))
    if n <= 0 or step <= 0:
        raise ValueError("window and stride must be at least one sample")
    keys = list(keys)
    size = F.size(data)
    last_start = F.col(samples) - n - 1  # starts run over [0, samples - n)
    first = F.greatest(F.lit(0), F.ceil((F.col(position) - n + 1) / step)).cast("bigint")
    final = F.floor(F.least(F.col(position) + size - 1, last_start) / step).cast("bigint")
    touched = F.when(final >= first, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))
    pieces = chunks.select(*keys, position, data, F.explode(touched).alias("i"))
    start = F.greatest(F.col("i") * step, F.col(position))
    stop = F.least(F.col("i") * step + n, F.col(position) + size)
    pieces = pieces.select(
        *keys, "i",
        F.struct(
            start.alias("at"),
            F.slice(data, (start - F.col(position) + 1).cast("int"), (stop - start).cast("int")).alias("x"),
        ).alias("piece"),
    )
    # A window has at most window / chunk + 2 pieces.
    joined = pieces.groupBy(*keys, "i").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    flat = F.flatten(F.transform("p", lambda e: e["x"]))
    found = joined.select(*keys, "i", F.when(F.size(flat) == n, F.transform(flat, lambda x: x.cast("double"))).alias("window"))
    count = F.ceil((F.col(samples) - n) / step).cast("bigint")
    whole = chunks.select(*keys, samples).distinct().filter(count > 0)
    grid = whole.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("i"))
    centre = F.col("span_start") + F.col("i") * F.lit(step / fs) + 0.5 * window_s
    window = F.coalesce("window", F.array_repeat(F.lit(0.0), n))
    return grid.join(found, [*keys, "i"], "left").select(*keys, "i", centre.alias("t_centre"), window.alias("window"))


def floor_psd(psd: DataFrame, relative: float = 1e-10, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Add floored and asd: the PSD raised to a small fraction of the median of its positive finite bins.

    A channel without such bins stops the query.
    """
    by = list(by)
    clean = F.when((F.col("psd") > 0) & ~F.isnan("psd") & (F.col("psd") < float("inf")), F.col("psd"))
    median = percentiles(psd.withColumn("_pos", clean), "_pos", {"_median": 0.5}, by)
    out = psd.join(median, by) if by else psd.crossJoin(F.broadcast(median))  # one row
    none = F.raise_error(F.lit("reference PSD has no positive finite bins")).cast("double")
    floor = F.coalesce(F.col("_median"), none) * F.lit(relative)
    out = out.withColumn("floored", F.greatest(F.when(~F.isnan("psd"), F.col("psd")), floor))
    return out.withColumn("asd", F.sqrt("floored")).drop("_median")


def psd_curves(psd: DataFrame, column: str = "floored", by: Sequence[str] = ("channel",)) -> DataFrame:
    """(by..., freq, psd): each reference curve as two arrays in the order of frequency."""
    bins = F.array_sort(F.collect_list(F.struct(F.col("freq").cast("double").alias("f"), F.col(column).cast("double").alias("s"))))
    return psd.groupBy(*by).agg(bins.alias("_bins")).select(*by, F.col("_bins.f").alias("freq"), F.col("_bins.s").alias("psd"))


def network_snr(
    series: DataFrame, curves: DataFrame | dict[str, tuple], fs: float, data: str = "series", f_low: float = 20.0, by: Sequence[str] = ("channel",),
) -> DataFrame:
    """Root sum of squares of the per-channel optimal SNR of each source, (source_id, network_snr).

    `curves` has one row per channel, or per channel and epoch where `by` says so: (by..., freq, psd), as `psd_curves` makes them. A
    curve meets the series by a join, so neither its length nor their number is limited by the driver. A dictionary of channel to (freq, psd) will
    do too. Series without a curve have no part in the sum.
    """
    by = list(by)
    if isinstance(curves, dict):
        rows = [(c, [float(x) for x in f], [float(x) for x in s]) for c, (f, s) in curves.items()]
        curves = series.sparkSession.createDataFrame(rows, "channel string, freq array<double>, psd array<double>")
    snr = kernels.optimal_snr_on_curve(fs, f_low)
    joined = series.select("source_id", *by, data).join(curves.select(*by, "freq", "psd"), by)
    return joined.withColumn("snr", snr("freq", "psd", data)).groupBy("source_id").agg(F.sqrt(F.sum(F.col("snr") * F.col("snr"))).alias("network_snr"))


def rescale_to_target(series: DataFrame, data: str = "series", current: str = "current_snr", target: str = "target_snr") -> DataFrame:
    """Scale every channel of a source by one factor, so amplitudes relative to each other stay."""
    bad = F.raise_error(F.lit("current network SNR must be positive")).cast("double")
    factor = F.col(target) / F.when(F.col(current) > 0, F.col(current)).otherwise(bad)
    return series.withColumn(data, rescale(data, factor))


def paired_band_crop(pairs: DataFrame, magnitude_a: str = "mag_a", magnitude_b: str = "mag_b", t0: str = "t0_a") -> DataFrame:
    """Both channels cropped at the column of channel a's attention peak, for the two specialist bands."""
    column = column_for(t0, F.size(F.element_at(magnitude_a, 1)))
    bands = (HIGH_MASS_BAND_HZ, LOW_MASS_BAND_HZ)
    crops = band_crops([(m, band) for band in bands for m in (magnitude_a, magnitude_b)], "_column")
    out = pairs.withColumn("_column", column).withColumn("_crops", crops)
    return out.withColumns({"hm": F.array("_crops.c0", "_crops.c1"), "lm": F.array("_crops.c2", "_crops.c3")}).drop("_column", "_crops")


def coherence_rows(
    pairs: DataFrame, first_bin: int, n: int, lag_samples: int, names=("re_a", "im_a", "re_b", "im_b"), out: str = "coherence"
) -> DataFrame:
    udf = kernels.coherence_from_coefficients(first_bin, n, lag_samples)
    return pairs.withColumn(out, udf(*[F.transform(F.col(c), lambda x: x.cast("double")) for c in names]))


def band_bins(fs: float, window_s: float, band) -> tuple[int, int, int]:
    """(first bin, bin count, window length) of a band; it depends on the coherence window only."""
    n = 2 * int(window_s * fs / 2)
    lo, hi = math.ceil(band[0] * n / fs - 1e-9), math.floor(band[1] * n / fs + 1e-9)
    return lo, hi - lo + 1, n
