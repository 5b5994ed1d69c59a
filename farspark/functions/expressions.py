"""Column expressions: everything here is a plain Catalyst expression, so it stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

SECONDS_PER_YEAR = 365.25 * 86400.0

# The published selection constants every comparison depends on.
COHERENCE_CUT = 0.12767678245902062
CENTROID_CUT_HZ = 190.78961461069167
COHERENCE_BAND_HZ = (20.0, 500.0)
COHERENCE_WINDOW_S = 1.0
COHERENCE_LAG_SAMPLES = 45
CENTROID_BAND_HZ = (20.0, 400.0)
CENTROID_WINDOW_S = 0.5
GLITCH_THRESHOLD = 0.5
HIGH_MASS_BAND_HZ = (20.0, 140.0)
LOW_MASS_BAND_HZ = (50.0, 500.0)
CROP_COLUMNS = 113
ATTENTION_CLAMP = (14, 113)
ARM_CLIP = 6.0
ARM_RAMP_SIGMA = 3.0
COMPONENT_MASS_RANGE = (10.0, 120.0)
TOTAL_MASS_RANGE = (20.0, 240.0)
MASS_RATIO_MAX = 6.0
SNR_EDGES = (6.0, 8.0, 10.0, 12.0, 15.0, 20.0, 25.0, 32.0, 40.0)
MASS_EDGES = (20.0, 40.0, 60.0, 100.0, 160.0, 240.0)
REPORT_MASS_EDGES = (20.0, 60.0, 100.0, 240.0)
FREQUENCY_EDGES = (40.0, 55.0, 70.0, 90.0, 115.0, 150.0, 200.0, 270.0, 400.0)
FAR_SNR_EDGES = (6.0, 10.0, 15.0, 25.0, 40.0)
FRONT_END_SNR_EDGES = (8.0, 10.0, 12.0, 15.0, 20.0, 25.0)
FEATURES = ("sigma_a", "sigma_b", "coherence", "centroid_a", "centroid_b", "gated_arm_a", "gated_arm_b")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def nan_to_null(c) -> Column:
    """Spark orders NaN above every number; a NaN statistic must never pass a cut, so it becomes NULL."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def passes(stat, threshold, inclusive: bool = True) -> Column:
    """`stat >= threshold` (or `>`), false for NaN and NULL on either side."""
    s, t = nan_to_null(stat), nan_to_null(_num(threshold) if not isinstance(threshold, str) else threshold)
    return F.coalesce(s >= t if inclusive else s > t, F.lit(False))


def clip(c, lo: float, hi: float) -> Column:
    c = _col(c)
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def ratio(num, den) -> Column:
    """Division that gives NULL instead of an ANSI error when the denominator is zero."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


# --- statistics -----------------------------------------------------------------------------


def net_sigma(a, b) -> Column:
    """Joint statistic of two standardised scores: their sum over sqrt(2)."""
    return (_col(a) + _col(b)) / F.lit(math.sqrt(2.0))


def keep_above(stat, floor: float) -> Column:
    return passes(stat, floor, inclusive=False)


def is_massive(coherence, centroid_a, centroid_b, tcoh: float = COHERENCE_CUT, f_cut: float = CENTROID_CUT_HZ) -> Column:
    """Strict-channel membership: both centroids low and the pair coherent."""
    low = (nan_to_null(centroid_a) < f_cut) & (nan_to_null(centroid_b) < f_cut)
    return F.coalesce(low & (nan_to_null(coherence) >= tcoh), F.lit(False))


def is_glitch(hm, lm, threshold: float = GLITCH_THRESHOLD) -> Column:
    return F.greatest(_col(hm), _col(lm)) < threshold


def channel_definitions(coherence="coherence", centroid_a="centroid_a", centroid_b="centroid_b") -> dict[str, Column]:
    """The four named channel predicates compared by the veto ablation."""
    low = F.coalesce(
        (nan_to_null(centroid_a) < CENTROID_CUT_HZ) & (nan_to_null(centroid_b) < CENTROID_CUT_HZ), F.lit(False)
    )
    return {
        "none": F.lit(True),
        "coherence": passes(coherence, COHERENCE_CUT),
        "morphology": low,
        "both": is_massive(coherence, centroid_a, centroid_b),
    }


def arm_gate(g, sigma) -> Column:
    """A classifier logit, clipped and faded in with loudness."""
    return clip(g, -ARM_CLIP, ARM_CLIP) * clip(_col(sigma) / F.lit(ARM_RAMP_SIGMA), 0.0, 1.0)


def lr_features(
    sigma_a="sigma_a", sigma_b="sigma_b", coherence="coherence", centroid_a="centroid_a", centroid_b="centroid_b",
    arm_a="arm_a", arm_b="arm_b",
) -> list[Column]:
    """The seven ranking features, as DOUBLE columns in model order."""
    plain = [_col(c).cast("double") for c in (sigma_a, sigma_b, coherence, centroid_a, centroid_b)]
    gated = [arm_gate(_col(g).cast("double"), _col(s).cast("double")) for g, s in ((arm_a, sigma_a), (arm_b, sigma_b))]
    return [c.alias(n) for c, n in zip(plain + gated, FEATURES)]


def log_likelihood_ratio(features: Sequence, mu: Sequence, sd: Sequence, beta: Sequence) -> Column:
    """Intercept plus the weighted sum of the standardised features, one term per column."""
    out = _num(beta[0])
    for f, m, s, b in zip(features, mu, sd, beta[1:]):
        out = out + (_col(f) - _num(m)) / _num(s) * _num(b)
    return out


def apply_temperature(z, temperature) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z) / _num(temperature)))


def trials_factor(n_statistics: int = 2, n_arms: int = 2) -> int:
    """How many independent looks a false-alarm rate is penalised for."""
    return int(n_statistics) * int(n_arms)


def far_rate(n_louder, livetime_yr, trials) -> Column:
    """Events per year for an inclusive louder-count; one count is the smallest that can be claimed."""
    return _num(trials) * F.greatest(_col(n_louder), F.lit(1)).cast("double") / _num(livetime_yr)


def wilson_bound(k, n, z: float = 1.0, upper: bool = False) -> Column:
    """One end of the Wilson score interval, clamped to [0, 1]; zero when there are no trials."""
    k, n = _col(k).cast("double"), _col(n).cast("double")
    safe = F.when(n > 0, n)
    p = k / safe
    denominator = 1.0 + z * z / safe
    centre = (p + z * z / (2.0 * safe)) / denominator
    half = z * F.sqrt(p * (1.0 - p) / safe + z * z / (4.0 * safe * safe)) / denominator
    edge = F.least(F.lit(1.0), centre + half) if upper else F.greatest(F.lit(0.0), centre - half)
    return F.when(n > 0, edge).otherwise(F.lit(0.0))


def wilson_interval(k, n, z: float = 1.0) -> tuple[Column, Column]:
    return wilson_bound(k, n, z).alias("lo"), wilson_bound(k, n, z, upper=True).alias("hi")


def sensitive_distance_mpc(volume_gpc3) -> Column:
    """Radius of the Euclidean sphere with this volume."""
    return F.pow(_col(volume_gpc3) * F.lit(3.0 * 1e9 / (4.0 * math.pi)), F.lit(1.0 / 3.0))


def bin_index(c, edges: Sequence[float], clamp_last: bool = False) -> Column:
    """0-based half-open bin `[edge, next edge)` by literal edges; NULL outside.

    `clamp_last` folds values under the first and at or over the last edge into the end bins.
    """
    c = nan_to_null(c)
    n = len(edges) - 1
    position = F.lit(-1)
    for e in edges:
        position = position + (c >= F.lit(float(e))).cast("int")
    if clamp_last:
        return F.least(F.greatest(position, F.lit(0)), F.lit(n - 1))
    return F.when((position >= 0) & (position < n), position)


# --- sources, crops and tables --------------------------------------------------------------


def total_mass(m1, m2) -> Column:
    return _col(m1) + _col(m2)


def mass_ratio(m1, m2) -> Column:
    return ratio(F.greatest(_col(m1), _col(m2)), F.least(_col(m1), _col(m2)))


def admissible(
    m1, m2, component=COMPONENT_MASS_RANGE, total=TOTAL_MASS_RANGE, q_max: float = MASS_RATIO_MAX
) -> Column:
    """Joint acceptance of a candidate mass pair: components, total and ratio together."""
    m1, m2 = _col(m1), _col(m2)
    inside = m1.between(*component) & m2.between(*component)
    return inside & (m1 + m2).between(*total) & (mass_ratio(m1, m2) <= q_max)


def column_for(t0, n_columns) -> Column:
    """Tile time column to native column; half-way cases go to the even side."""
    return F.rint((_col(t0) - ATTENTION_CLAMP[0]) / F.lit(128.0) * _col(n_columns)).cast("int")


def crop_bounds(n_cols, total_seconds, crop_seconds) -> tuple[Column, Column]:
    """Central column range `[start, stop)` of a crop; everything when the crop is absent or not shorter."""
    n, total, crop = _col(n_cols), _col(total_seconds), _col(crop_seconds)
    whole = F.coalesce((crop <= 0) | (crop >= total), F.lit(True))
    r = crop / total
    start = F.least(F.greatest(F.floor(0.5 * (1.0 - r) * n), F.lit(0)), n).cast("int")
    stop = F.least(F.greatest(F.floor(0.5 * (1.0 + r) * n), start + 1), n).cast("int")
    return F.when(whole, F.lit(0)).otherwise(start), F.when(whole, n.cast("int")).otherwise(stop)


def budget_verdict(candidate, baseline, tolerance: float = 0.10) -> tuple[Column, Column]:
    """(inside the band, candidate over baseline)."""
    c, b = _col(candidate), _col(baseline)
    return (F.abs(c - b) <= tolerance * b).alias("passed"), ratio(c, b).alias("ratio")
