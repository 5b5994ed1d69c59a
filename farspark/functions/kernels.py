"""Arrow-batched signal kernels for array columns: NumPy inside tasks, Spark around them.

Fourier transforms have no built-in expression, so these are pandas UDFs; crops are one for speed. Each works on one Arrow batch of
independent rows; a row never needs another row, so batches and partitions may be cut anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from farspark.functions.expressions import (
    CENTROID_BAND_HZ,
    CENTROID_WINDOW_S,
    COHERENCE_BAND_HZ,
    COHERENCE_LAG_SAMPLES,
    COHERENCE_WINDOW_S,
)

_SERIES = T.ArrayType(T.DoubleType())
_COEFFICIENTS = T.StructType(
    [
        T.StructField("re", _SERIES),
        T.StructField("im", _SERIES),
        T.StructField("first_bin", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
    ]
)


def _by_length(*columns: pd.Series):
    """Yield (row positions, matrices) per distinct set of lengths, so ragged batches vectorise too."""
    shapes = pd.Series(list(zip(*[c.map(len) for c in columns])))
    for _, rows in shapes.groupby(shapes):
        at = rows.index.to_numpy()
        yield at, [np.stack([np.asarray(c.iloc[i], dtype=float) for i in at]) for c in columns]


def _scalar(fn, *columns: pd.Series) -> pd.Series:
    out = np.full(len(columns[0]), np.nan)
    for at, mats in _by_length(*columns):
        out[at] = fn(*mats)
    return pd.Series(out)


def _series(fn, *columns: pd.Series) -> pd.Series:
    out = [None] * len(columns[0])
    for at, mats in _by_length(*columns):
        for i, row in zip(at, fn(*mats)):
            out[i] = row
    return pd.Series(out)


#: Bytes of crops a task hands back at once, whatever the size of the batch it got.
CROP_BYTES = 8 << 20


def _padded(window: pa.ListArray, at: np.ndarray, known: np.ndarray, width: int) -> pa.ListArray:
    """Crops of a batch: stored rows put at their place among zeros, then scaled by each crop's own least and largest value.

    NaN is larger than any number, a null is no value and stays null, and a null row leaves its crop without values.
    """
    there = window.is_valid().to_numpy(zero_copy_only=False)
    outer = np.asarray(window.offsets)
    heights = np.where(there, np.diff(outer), 0)
    edges = np.concatenate([[0], np.cumsum(heights)])
    rows = window.flatten()
    of = np.repeat(np.arange(len(heights)), heights)
    stored = rows.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(stored, np.diff(np.asarray(rows.offsets)), 0)
    flat = rows.flatten()
    ends = np.cumsum(lengths)
    place = np.repeat(np.arange(len(rows)) * width + np.maximum(-at[of], 0) - (ends - lengths), lengths) + np.arange(len(flat))
    cells = np.zeros(len(rows) * width)
    cells[place] = flat.to_numpy(zero_copy_only=False)
    empty = np.zeros(len(cells), bool)
    if flat.null_count:
        empty[place] = flat.is_null().to_numpy(zero_copy_only=False)
    tall = heights > 0
    cuts = edges[:-1][tall] * width
    broken = ~known[of] & (lengths > 0)
    if len(cuts):
        low, high = np.full(len(heights), np.nan), np.full(len(heights), np.nan)
        some = bool(flat.null_count)
        low[tall] = np.fmin.reduceat(np.where(empty, np.nan, cells) if some else cells, cuts)
        high[tall] = np.maximum.reduceat(np.where(empty, -np.inf, cells) if some else cells, cuts)
        without = np.zeros(len(heights), bool)
        without[of[~stored | broken]] = True
        with np.errstate(invalid="ignore", over="ignore"):
            square = cells.reshape(-1, width)
            square -= low[of][:, None]
            square /= (high - low + 1e-9)[of][:, None]
        empty |= np.repeat(without[of], width)
    values = pa.array(cells, mask=empty) if empty.any() else pa.array(cells)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), values, mask=pa.array(~stored | broken))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), inner, mask=pa.array(~there))


def padded_crops(n: int, width: int):
    """From a struct of the first column (`at`) and `n` windows (c0, c1, ...), each the stored part of a crop, a struct of whole crops."""
    names = [f"c{k}" for k in range(n)]

    @F.arrow_udf(f"struct<{', '.join(f'{c}: array<array<double>>' for c in names)}>")
    def crops(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            first, windows = batch.field("at"), [batch.field(c) for c in names]
            at = first.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = first.is_valid().to_numpy(zero_copy_only=False)
            heights = sum((np.diff(np.asarray(w.offsets)) for w in windows), np.zeros(len(first), np.int64))
            piece = np.cumsum(heights * width * 8) // CROP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(first)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i < j or len(first) == 0:
                    yield pa.StructArray.from_arrays([_padded(w.slice(i, j - i), at[i:j], known[i:j], width) for w in windows], names)

    return crops


def middle(x: np.ndarray, fs: float, seconds: float) -> np.ndarray:
    half = int(seconds * fs / 2)
    mid = x.shape[1] // 2
    return x[:, mid - half : mid + half]


def in_band(n: int, fs: float, band) -> np.ndarray:
    f = np.fft.rfftfreq(n, 1.0 / fs)
    return (f >= band[0]) & (f <= band[1])


def band_pass(x: np.ndarray, fs: float, band) -> np.ndarray:
    n = x.shape[1]
    spectrum = np.fft.rfft(x * np.hanning(n), axis=1)
    return np.fft.irfft(np.where(in_band(n, fs, band), spectrum, 0.0), n=n, axis=1)


def symmetric_coherence(a: np.ndarray, b: np.ndarray, lag_samples: int) -> np.ndarray:
    """Largest absolute circular cross-product over the lags, over the mean energy of the two rows."""
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    n = a.shape[1]
    scan = np.fft.irfft(np.fft.rfft(a, axis=1) * np.conj(np.fft.rfft(b, axis=1)), n=n, axis=1)
    lags = np.arange(-lag_samples, lag_samples + 1) % n
    return 2.0 * np.abs(scan[:, lags]).max(1) / ((a * a).sum(1) + (b * b).sum(1) + 1e-30)


def lag_rotation(first_bin: int, bins: int, n: int, lag_samples: int) -> np.ndarray:
    """Phase of every stored bin at every wanted lag: (bins, lags)."""
    f = np.arange(first_bin, first_bin + bins)
    tau = np.arange(-lag_samples, lag_samples + 1)
    return np.exp(2j * np.pi / n * np.outer(f, tau))


def coefficient_coherence(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, n: int) -> np.ndarray:
    """Coherence of paired coefficient rows, where every one-sided bin counts twice."""
    top = np.abs(((a * b.conj()) @ rotation).real).max(1)
    energy = (a.real**2 + a.imag**2).sum(1) + (b.real**2 + b.imag**2).sum(1)
    return 4.0 / n * top / (2.0 / n * energy + 1e-30)


def bandlimit(fs: float = 4096, band=COHERENCE_BAND_HZ):
    """UDF: taper, keep only the band, transform back."""

    @F.pandas_udf(_SERIES)
    def run(x: pd.Series) -> pd.Series:
        return _series(lambda m: band_pass(m, fs, band), x)

    return run


def coherence(fs: float = 4096, band=COHERENCE_BAND_HZ, window_s=COHERENCE_WINDOW_S, lag_samples=COHERENCE_LAG_SAMPLES):
    """UDF (series a, series b) -> coherence of the central windows."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def score(x, y):
            x, y = (band_pass(middle(s, fs, window_s), fs, band) for s in (x, y))
            return symmetric_coherence(x, y, lag_samples)

        return _scalar(score, a, b)

    return run


def centroid(fs: float = 4096, band=CENTROID_BAND_HZ, window_s=CENTROID_WINDOW_S):
    """UDF: energy-weighted mean frequency of the central window."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        def score(m):
            w = middle(m, fs, window_s)
            n = w.shape[1]
            keep = in_band(n, fs, band)
            power = np.abs(np.fft.rfft((w - w.mean(1, keepdims=True)) * np.hanning(n), axis=1)[:, keep]) ** 2
            return power @ np.fft.rfftfreq(n, 1.0 / fs)[keep] / (power.sum(1) + 1e-30)

        return _scalar(score, x)

    return run


def band_coefficients(fs: float = 4096, band=COHERENCE_BAND_HZ, window_s=COHERENCE_WINDOW_S):
    """UDF: in-band Fourier coefficients of the tapered central window, with the first bin and window length."""

    @F.pandas_udf(_COEFFICIENTS)
    def run(x: pd.Series) -> pd.DataFrame:
        out = [None] * len(x)
        for at, (m,) in _by_length(x):
            w = middle(m, fs, window_s)
            n = w.shape[1]
            keep = in_band(n, fs, band)
            c = np.fft.rfft(w * np.hanning(n), axis=1)[:, keep]
            for i, row in zip(at, c):
                out[i] = (row.real, row.imag, int(np.argmax(keep)), n)
        return pd.DataFrame(out, columns=["re", "im", "first_bin", "n"])

    return run


def coherence_from_coefficients(first_bin: int, n: int, lag_samples=COHERENCE_LAG_SAMPLES):
    """UDF (re a, im a, re b, im b) -> coherence; one small matrix product per batch."""

    @F.pandas_udf("double")
    def run(ar: pd.Series, ai: pd.Series, br: pd.Series, bi: pd.Series) -> pd.Series:
        def score(p, q, r, s):
            return coefficient_coherence(p + 1j * q, r + 1j * s, lag_rotation(first_bin, p.shape[1], n, lag_samples), n)

        return _scalar(score, ar, ai, br, bi)

    return run


def whiten_spectral(freq, floored_psd, fs: float = 4096):
    """UDF: divide the spectrum by the square root of a reference PSD, already floored."""
    f, s = np.asarray(freq, float), np.asarray(floored_psd, float)

    @F.pandas_udf(_SERIES)
    def run(x: pd.Series) -> pd.Series:
        def white(m):
            n = m.shape[1]
            amplitude = np.sqrt(np.interp(np.fft.rfftfreq(n, 1.0 / fs), f, s))
            return np.fft.irfft(np.fft.rfft(m, axis=1) / amplitude, n=n, axis=1)

        return _series(white, x)

    return run


def snr_of(m: np.ndarray, freq: np.ndarray, psd: np.ndarray, fs: float, f_low: float, f_high: float | None) -> np.ndarray:
    n = m.shape[1]
    grid = np.fft.rfftfreq(n, 1.0 / fs)
    noise = np.interp(grid, freq, psd)
    keep = (grid >= f_low) & (grid <= (grid[-1] if f_high is None else f_high)) & (noise > 0)
    density = np.abs(np.fft.rfft(m, axis=1)[:, keep] / fs) ** 2 / noise[keep]
    return np.sqrt(4.0 * fs / n * density.sum(1))


def optimal_snr(freq, psd, fs: float = 4096, f_low: float = 20.0, f_high: float | None = None):
    """UDF: optimal signal-to-noise ratio of a series against a reference PSD over a band; 0 for an empty band."""
    f, s = np.asarray(freq, float), np.asarray(psd, float)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return _scalar(lambda m: snr_of(m, f, s, fs, f_low, f_high), x)

    return run


def optimal_snr_on_curve(fs: float = 4096, f_low: float = 20.0, f_high: float | None = None):
    """UDF (freq, psd, series) -> optimal SNR against the reference curve of the same row. Rows of one curve are worked on together."""

    @F.pandas_udf("double")
    def run(freq: pd.Series, psd: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        curve = pd.Series([hash((f.tobytes(), s.tobytes())) for f, s in zip(freq, psd)], index=x.index)
        for _, rows in x.groupby(curve):
            f, s = np.asarray(freq[rows.index[0]], float), np.asarray(psd[rows.index[0]], float)
            out[rows.index] = _scalar(lambda m: snr_of(m, f, s, fs, f_low, f_high), rows.reset_index(drop=True)).to_numpy()
        return out

    return run


def matched_filter_peak(fs: float = 4096, keep_s: float = 2.0):
    """UDF (data, template, sigma) -> largest absolute circular correlation of the central seconds, in sigmas."""

    @F.pandas_udf("double")
    def run(data: pd.Series, template: pd.Series, sigma: pd.Series) -> pd.Series:
        out = np.full(len(data), np.nan)
        for at, (d, t) in _by_length(data, template):
            k = int(keep_s * fs)
            first = (d.shape[1] - k) // 2
            d, t = d[:, first : first + k], t[:, first : first + k]
            scan = np.fft.irfft(np.fft.rfft(d, axis=1) * np.conj(np.fft.rfft(t, axis=1)), n=k, axis=1)
            norm = np.sqrt((t * t).sum(1)) * sigma.to_numpy(float)[at]
            out[at] = np.divide(np.abs(scan).max(1), norm, out=np.full(len(at), np.nan), where=norm > 0)
        return pd.Series(out)

    return run


def fractional_delay():
    """UDF (series, samples) -> circular delay by a real number of samples; over a quarter length is refused."""

    @F.pandas_udf(_SERIES)
    def run(x: pd.Series, samples: pd.Series) -> pd.Series:
        out = [None] * len(x)
        for at, (m,) in _by_length(x):
            n = m.shape[1]
            shift = samples.to_numpy(float)[at]
            if (np.abs(shift) > 0.25 * n).any():
                raise ValueError("delay is more than a quarter of the series; it would wrap the signal")
            ramp = np.exp(-2j * np.pi * np.outer(shift, np.fft.rfftfreq(n)))
            for i, row in zip(at, np.fft.irfft(np.fft.rfft(m, axis=1) * ramp, n=n, axis=1)):
                out[i] = row
        return pd.Series(out)

    return run
