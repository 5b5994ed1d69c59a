"""Array-valued expressions written with higher-order functions, evaluated in the JVM; crops end in an Arrow kernel."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from farspark.functions import kernels
from farspark.functions.expressions import CROP_COLUMNS, _col


def _double(a) -> Column:
    return F.transform(_col(a), lambda x: x.cast("double"))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once: a lambda re-evaluates what it captures for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a) -> Column:
    return F.try_divide(_fold_sum(_double(a)), F.size(_col(a)).cast("double"))


def array_std(a) -> Column:
    """Population standard deviation of one array, two passes so large offsets do not cancel."""
    a = _double(a)
    n = F.size(a).cast("double")
    return F.sqrt(
        F.try_divide(
            F.aggregate(
                a,
                F.struct(F.lit(0.0).alias("s"), (_fold_sum(a) / F.when(n > 0, n)).alias("m")),
                lambda acc, x: F.struct((acc["s"] + (x - acc["m"]) * (x - acc["m"])).alias("s"), acc["m"].alias("m")),
            )["s"],
            n,
        )
    )


def fraction_above(a, level: float = 0.5) -> Column:
    a = _col(a)
    return F.try_divide(F.size(F.filter(a, lambda x: x > level)).cast("double"), F.size(a).cast("double"))


def min_max_norm(a, eps: float = 1e-12) -> Column:
    """Scale one array to [0, 1] by its own range."""
    a = _double(a)
    ends = F.struct(a.alias("a"), F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    return let(ends, lambda s: F.transform(s["a"], lambda x: (x - s["lo"]) / (s["hi"] - s["lo"] + F.lit(eps))))


def noise_referenced_norm(a, mean, std) -> Column:
    """Standardise by statistics measured elsewhere (the training fold); both are required."""
    if mean is None or std is None:
        raise ValueError("noise_referenced_norm needs the training fold's mean and standard deviation")
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    std = std if isinstance(std, Column) else F.lit(float(std))
    return F.transform(_col(a), lambda x: (x.cast("double") - mean) / (std + F.lit(1e-12)))


def centre_crop(a, fs: float, seconds: float | None) -> Column:
    """Central `seconds` of a series; the whole series when that is absent, not positive or not shorter."""
    a = _col(a)
    if seconds is None or seconds <= 0:
        return a
    target = int(round(seconds * fs))
    if target <= 0:
        return a
    n = F.size(a)
    start = F.floor((n - target) / 2).cast("int")
    return F.when(n <= target, a).otherwise(F.slice(a, start + 1, target))


def energy_fraction_in_crop(a, fs: float, seconds: float) -> Column:
    """Share of the squared amplitude inside the central `seconds`; zero for a silent series."""
    a = _double(a)
    keep = int(round(seconds * fs))
    start = F.greatest(F.lit(0), F.floor((F.size(a) - keep) / 2)).cast("int")
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
    total = square(a)
    return F.when(total > 0, square(F.slice(a, start + 1, keep)) / total).otherwise(F.lit(0.0))


def reconstruction_error(a, b) -> Column:
    """Mean squared difference of two equal-length arrays."""
    squares = F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))
    return F.try_divide(_fold_sum(squares), F.size(_col(a)).cast("double"))


def rescale(series, factor) -> Column:
    both = F.struct(_col(series).alias("x"), _col(factor).alias("f"))
    return let(both, lambda s: F.transform(s["x"], lambda x: x * s["f"]))


def cut_window(series, offset_s, duration_s, fs: float) -> Column:
    """`duration_s` of a series from `offset_s`; running past either end stops the query."""
    series = _col(series)
    first = F.rint(_col(offset_s) * fs).cast("int")
    n = F.rint(_col(duration_s) * fs).cast("int")
    bad = (first < 0) | (first + n > F.size(series))
    return F.when(bad, F.raise_error(F.lit("window runs past the segment"))).otherwise(F.slice(series, first + 1, n))


def band_crops(crops, column, f_low: float = 10.0, f_res: float = 0.5, width: int = CROP_COLUMNS) -> Column:
    """A struct (c0, c1, ...) with one crop per (magnitude, band): the rows of a frequency-by-time magnitude inside `band`, `width`
    columns from `column` zero-padded past either end, scaled to [0, 1] over the whole crop.

    What a crop needs of a magnitude is cut out here; an Arrow kernel pads and scales it.
    """
    first = _col(column).cast("int")

    def window(magnitude, band) -> Column:
        rows = _col(magnitude)
        lo_row = max(0, math.ceil((band[0] - f_low) / f_res - 1e-9))
        hi_row = math.floor((band[1] - f_low) / f_res + 1e-9)
        rows = F.slice(rows, lo_row + 1, hi_row - lo_row + 1)

        # A slice ends where its row does. Spark finds no Arrow function whose arguments nest lambdas, so there is no `let` here.
        start, n = F.greatest(first, F.lit(0)) + 1, F.greatest(F.least(first, F.lit(0)) + width, F.lit(0))
        cut = F.transform(rows, lambda r: F.slice(r, start, n))
        return cut.cast("array<array<double>>")

    windows = [window(m, band).alias(f"c{k}") for k, (m, band) in enumerate(crops)]
    return kernels.padded_crops(len(crops), width)(F.struct(first.alias("at"), *windows))


def band_crop(magnitude, column, band, f_low: float = 10.0, f_res: float = 0.5, width: int = CROP_COLUMNS) -> Column:
    """One crop of `band_crops`."""
    return band_crops([(magnitude, band)], column, f_low, f_res, width)["c0"]


def coherence_from_coefficients_sql(
    a_re, a_im, b_re, b_im, first_bin: int, n: int, lag_samples: int
) -> Column:
    """Lag-scanned symmetric coherence from stored band coefficients, without leaving the JVM.

    Suits short coefficient arrays; the Arrow kernel in `kernels.py` is the bulk form.
    """
    a_re, a_im, b_re, b_im = (_double(c) for c in (a_re, a_im, b_re, b_im))
    power = lambda re, im: _fold_sum(F.zip_with(re, im, lambda x, y: x * x + y * y))
    energy = (power(a_re, a_im) + power(b_re, b_im)) * F.lit(2.0 / n)
    cross_re = F.zip_with(
        F.zip_with(a_re, b_re, lambda x, y: x * y), F.zip_with(a_im, b_im, lambda x, y: x * y), lambda x, y: x + y
    )
    cross_im = F.zip_with(
        F.zip_with(a_im, b_re, lambda x, y: x * y), F.zip_with(a_re, b_im, lambda x, y: x * y), lambda x, y: x - y
    )
    pairs = F.arrays_zip(cross_re.alias("re"), cross_im.alias("im"))

    def scan(z: Column) -> Column:
        def at(lag: Column) -> Column:
            turn = lambda i: (i + F.lit(first_bin)) * lag * F.lit(2.0 * math.pi / n)
            terms = F.transform(z, lambda p, i: p["re"] * F.cos(turn(i)) - p["im"] * F.sin(turn(i)))
            return F.abs(_fold_sum(terms)) * F.lit(4.0 / n)

        return F.array_max(F.transform(F.sequence(F.lit(-lag_samples), F.lit(lag_samples)), at))

    return let(pairs, scan) / (energy + F.lit(1e-30))
