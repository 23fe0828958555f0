"""Signal kernels in numpy, run as pandas UDFs over arrays of samples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@cache
def bandpass_sections(low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Second-order sections of a digital Butterworth band-pass: prototype poles, band transform, bilinear map."""
    if not 0 < low < high < fs / 2:
        raise ValueError(f"invalid band {low}-{high} at {fs}")
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    half, centre = poles * (w2 - w1) / 2, w1 * w2
    root = np.sqrt(half**2 - centre)
    analog = np.concatenate([half + root, half - root])
    z = (2 * fs + analog) / (2 * fs - analog)
    z = z[z.imag > 0]
    z = z[np.argsort(np.abs(z))]
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in z])
    # unit gain at the digital band's geometric centre
    w = 2 * np.arctan(np.sqrt(w1 * w2) / (2 * fs))
    e = np.exp(-1j * w * np.arange(3))
    gain = np.prod([abs((s[:3] @ e) / (s[3:] @ e)) for s in sections])
    sections[0, :3] /= gain
    return sections


def _start_state(s: np.ndarray) -> np.ndarray:
    """State of a section that has seen a constant 1 for ever."""
    b, a = s[:3], s[3:]
    steady = b.sum() / a.sum()
    return np.array([b[1] + b[2] - (a[1] + a[2]) * steady, b[2] - a[2] * steady])


def _run(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter rows of x, each starting as if its first sample had lasted for ever."""
    level = x[:, 0].copy()
    y = x.astype(np.float64).copy()
    for s in sections:
        state = _start_state(s)
        z1, z2 = state[0] * level, state[1] * level
        out = np.empty_like(y)
        for t in range(y.shape[1]):
            v = y[:, t]
            o = s[0] * v + z1
            z1 = s[1] * v - s[4] * o + z2
            z2 = s[2] * v - s[5] * o
            out[:, t] = o
        level = level * (s[:3].sum() / s[3:].sum())
        y = out
    return y


def bandpass_rows(x: np.ndarray, low: float, high: float, fs: float, detrend: bool = False) -> np.ndarray:
    """Zero-phase band-pass of each row: forward and backward, with odd extension at both ends."""
    sections = bandpass_sections(low, high, fs)
    pad = 3 * (2 * len(sections) + 1)
    if x.shape[1] <= pad:
        raise ValueError(f"at least {pad + 1} samples are needed")
    if detrend:
        t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        x = x - x.mean(axis=1, keepdims=True) - np.outer((x * t).sum(axis=1) / (t * t).sum(), t)
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    y = _run(sections, _run(sections, ext)[:, ::-1])[:, ::-1]
    return y[:, pad:-pad]


#: Equally long rows that are worked on at once, so that what a batch takes beyond its own rows does not grow with it.
_ROWS = 1024


def _equal_rows(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of rows) of rows of one length, ``_ROWS`` at most; rows with a negative length are left out."""
    for n in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == n)
        for lo in range(0, len(rows), _ROWS):
            yield int(n), rows[lo : lo + _ROWS]


def _by_length(values: pd.Series, f) -> list:
    """Apply ``f`` to equally long rows together; null rows stay null."""
    out: list = [None] * len(values)
    arrays = list(values)
    for _, rows in _equal_rows(np.array([-1 if v is None else len(v) for v in arrays], np.int64)):
        # a copy, as a part of a greater array would keep all of it until the batch is done
        for k, y in zip(rows, f(np.stack([np.asarray(arrays[r], np.float64) for r in rows])).copy(), strict=True):
            out[k] = y
    return out


def bandpass(samples: Column, low: float, high: float, fs: float, detrend: bool = False) -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(_by_length(v, lambda x: bandpass_rows(x, low, high, fs, detrend)), index=v.index)

    return run(samples)


def welch_rows(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Power density of rows: periodic Hann segments, half overlapping, each without its mean."""
    n = min(nperseg, x.shape[1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segments = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, :: n - n // 2]
    segments = segments - segments.mean(axis=2, keepdims=True)
    power = np.abs(np.fft.rfft(segments * window, axis=2)) ** 2 / (fs * (window**2).sum())
    power[:, :, 1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power.mean(axis=1)


def welch(samples: Column, fs: float, nperseg: int = 1024) -> Column:
    """Power density of each array; bin k is at k * fs / min(nperseg, samples)."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(_by_length(v, lambda x: welch_rows(x, fs, nperseg)[1]), index=v.index)

    return run(samples)


def median_spectrum(rows: DataFrame, samples: str, fs: float, nperseg: int, keys: list[str]) -> DataFrame:
    """(keys, bin, frequency_hz, power): the median over rows of their power density in each bin."""
    n = F.least(F.size(samples), F.lit(nperseg))
    bins = rows.select(*keys, n.alias("n__"), F.posexplode(welch(F.col(samples), fs, nperseg)).alias("bin", "p"))
    return bins.groupBy(*keys, "bin").agg(F.first(F.col("bin") * fs / F.col("n__")).alias("frequency_hz"), F.median("p").alias("power"))


@cache
def tapers(n: int, bandwidth: float = 3.5, count: int = 5) -> np.ndarray:
    """Periodic discrete prolate sequences of n samples: of one more, without the last, by the commuting tridiagonal matrix."""
    m = n + 1
    t = np.arange(m)
    diagonal = ((m - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * bandwidth / m)
    beside = t[1:] * (m - t[1:]) / 2
    _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    return np.ascontiguousarray(vectors[:, ::-1][:, :count].T[:, :-1])


def multitaper_rows(x: np.ndarray, bandwidth: float = 3.5, count: int = 5) -> np.ndarray:
    """Root mean square amplitude over tapers; at least 32 samples."""
    if x.shape[1] < 32:
        raise ValueError("at least 32 samples are needed")
    x = x - x.mean(axis=1, keepdims=True)
    spectra = np.fft.rfft(tapers(x.shape[1], bandwidth, count)[None] * x[:, None, :], axis=2)
    return np.sqrt((np.abs(spectra) ** 2).mean(axis=1))


def multitaper(samples: Column, bandwidth: float = 3.5, count: int = 5) -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(_by_length(v, lambda x: multitaper_rows(x, bandwidth, count)), index=v.index)

    return run(samples)


def resample_rows(x: np.ndarray, down: int) -> np.ndarray:
    """Every ``down``-th sample after a Kaiser-windowed low-pass of 20 * down + 1 taps."""
    half = 10 * down
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / down) / down * np.kaiser(2 * half + 1, 5.0)
    taps /= taps.sum()
    padded = np.pad(x, ((0, 0), (half, half)))
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=1)[:, ::down] @ taps


def resample(samples: Column, down: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(_by_length(v, lambda x: resample_rows(x, down)), index=v.index)

    return run(samples)


def on_grid(samples: Column, start_s: Column, fs: Column, first_s: float, last_s: float) -> Column:
    """Linear interpolation of a trace on the grid first_s + k / fs, below last_s; null where the trace does not reach."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, start: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for x, s, r in zip(v, start, rate, strict=True):
            if x is None or r is None or len(x) < 16:
                out.append(None)
                continue
            x = np.asarray(x, float)
            n = int(round((last_s - first_s) * r))
            short = s > first_s + 1.5 / r or s + (len(x) - 1) / r < last_s - 1.5 / r
            out.append(None if short or n < 16 or np.isnan(x).any() else np.interp(first_s + np.arange(n) / r, s + np.arange(len(x)) / r, x))
        return pd.Series(out, index=v.index)

    return run(samples, start_s, fs)


def rms_snr(signal: Column, noise: Column) -> Column:
    """Ratio of root mean squares of two arrays."""
    rms = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a))
    return rms(signal) / (rms(noise) + 2.220446049250313e-16)


def lagged_peak_rows(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest normalised correlation of each row of x with that of y and its lag in samples; NaN without energy."""
    n = x.shape[1]
    correlation, lag = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if not n:
        return correlation, lag
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    good = np.flatnonzero(~(norm <= 0))
    size, k = 1 << (2 * n - 1).bit_length(), min(reach, n - 1)
    full = np.fft.irfft(np.fft.rfft(x[good], size, axis=1) * np.conj(np.fft.rfft(y[good], size, axis=1)), size, axis=1)
    values = np.concatenate([full[:, size - k :], full[:, : k + 1]], axis=1) / norm[good, None]
    at = values.argmax(axis=1)
    correlation[good], lag[good] = values[np.arange(len(good)), at], at - k
    return correlation, lag


def lagged_peak(first: Column, second: Column, fs: float, max_lag_s: float) -> Column:
    """struct(correlation, lag_s): greatest normalised correlation of two arrays within the lag; null without energy."""

    @F.pandas_udf("struct<correlation double, lag_s double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        reach = int(round(max_lag_s * fs))
        out = np.full((len(a), 2), np.nan)
        a, b = list(a), list(b)
        sizes = np.array([-1 if x is None or y is None else min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
        for n, rows in _equal_rows(sizes):
            x, y = (np.stack([np.asarray(v[r][:n], np.float64) for r in rows]) for v in (a, b))
            c, lag = lagged_peak_rows(x, y, reach)
            out[rows, 0], out[rows, 1] = c, lag / fs
        return pd.DataFrame(out, columns=["correlation", "lag_s"])

    return run(first, second)


_FIT = "struct<status string, corner_hz double, corner_std_hz double, omega_ratio double, min_hz double, max_hz double, points int, variance double, reason string>"
_FIT_COLUMNS = ["status", "corner_hz", "corner_std_hz", "omega_ratio", "min_hz", "max_hz", "points", "variance", "reason"]

#: Fits of one length that are worked on at once.
_FITS = 1024


def _normal(p: np.ndarray, f2: np.ndarray, fixed: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parameters (log level, log corner) of each fit: sum of squares, J'J and J'r over the points in use."""
    c2 = np.exp(2 * p[:, 1:])
    r = np.where(use, p[:, :1] + fixed - np.log1p(f2 / c2), 0.0)
    j = np.where(use, 2 * f2 / (c2 + f2), 0.0)
    a = np.empty((len(p), 2, 2))
    a[:, 0, 0], a[:, 1, 1] = use.sum(axis=1), (j * j).sum(axis=1)
    a[:, 0, 1] = a[:, 1, 0] = j.sum(axis=1)
    return (r * r).sum(axis=1), a, np.stack([r.sum(axis=1), (j * r).sum(axis=1)], axis=1)


def fit_corners(frequency: np.ndarray, ratio: np.ndarray, usable: np.ndarray, egf_corner: float, min_points: int = 20, edge: float = 1.25) -> pd.DataFrame:
    """Level and target corner of spectral ratios (rows) with a known reference corner: bounded, damped least squares of logarithms.

    All rows step at once; each has a damping of its own, which falls by 3 when a step helps and grows by 4 when it
    does not, and leaves when its step is below 1e-12 or its damping beyond 1e12.
    """
    use = usable & np.isfinite(frequency) & np.isfinite(ratio) & (frequency > 0) & (ratio > 0)
    points = use.sum(axis=1)
    with np.errstate(all="ignore"):
        low = np.where(use, frequency, np.inf).min(axis=1, initial=np.inf)
        high = np.where(use, frequency, -np.inf).max(axis=1, initial=-np.inf)
    out = pd.DataFrame({
        "status": "STOP", "corner_hz": np.nan, "corner_std_hz": np.nan, "omega_ratio": np.nan, "min_hz": np.where(points > 0, low, np.nan), "max_hz": np.where(points > 0, high, np.nan),
        "points": points.astype(int), "variance": np.nan, "reason": "too few usable spectral points",
    })
    rows = np.flatnonzero(points >= max(1, min_points))
    if not len(rows):
        return out
    use, f, low, high, points = use[rows], np.where(use[rows], frequency[rows], 1.0), low[rows], high[rows], points[rows]
    y = np.log(np.where(use, ratio[rows], 1.0))
    f2, fixed = f * f, np.log1p((f / egf_corner) ** 2) - y
    lower = np.stack([np.full(len(rows), np.log(1e-6)), np.log(low / 10)], axis=1)
    upper = np.stack([np.full(len(rows), np.log(1e6)), np.log(high * 10)], axis=1)
    level = np.log(np.nanmedian(np.where(use, ratio[rows], np.nan), axis=1))
    p = np.clip(np.stack([level, 0.5 * np.log(low * high)], axis=1), lower, upper)
    cost, a, g = _normal(p, f2, fixed, use)
    damp, active = np.full(len(rows), 1e-3), np.arange(len(rows))
    for _ in range(200):
        k = active
        diagonal = np.einsum("nii->ni", a[k])
        damped = a[k].copy()
        damped[:, [0, 1], [0, 1]] += damp[k, None] * (diagonal + 1e-12)
        q = np.clip(p[k] - np.linalg.solve(damped, g[k][..., None])[..., 0], lower[k], upper[k])
        cost_q, a_q, g_q = _normal(q, f2[k], fixed[k], use[k])
        better = cost_q <= cost[k]
        still = np.abs(q - p[k]).max(axis=1) < 1e-12
        won = k[better]
        p[won], cost[won], a[won], g[won] = q[better], cost_q[better], a_q[better], g_q[better]
        damp[k] = np.where(better, damp[k] / 3, damp[k] * 4)
        active = k[~(better & still) & ~(~better & (damp[k] > 1e12))]
        if not len(active):
            break
    corner, variance = np.exp(p[:, 1]), cost / np.maximum(1, points - 2)
    determinant = a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] ** 2
    with np.errstate(all="ignore"):
        std = np.where(determinant > 0, corner * np.sqrt(np.maximum(0.0, variance * a[:, 0, 0] / determinant)), np.nan)
        good = (edge * low <= corner) & (corner <= high / edge) & (std / corner <= 0.5)
    done = {
        "status": np.where(good, "PASS", "STOP"), "corner_hz": corner, "corner_std_hz": std, "omega_ratio": np.exp(p[:, 0]), "variance": variance,
        "reason": np.where(good, "resolved inside usable band", "corner is edge-limited or uncertainty exceeds 50%"),
    }
    for c, v in done.items():
        out.loc[rows, c] = v
    return out


def fit_corner(frequency: np.ndarray, ratio: np.ndarray, usable: np.ndarray, egf_corner: float, min_points: int = 20, edge: float = 1.25) -> dict:
    """:func:`fit_corners` of one ratio; what is not known is None."""
    row = fit_corners(frequency[None], ratio[None], usable[None], egf_corner, min_points, edge).iloc[0].to_dict()
    return {c: None if isinstance(v, float) and np.isnan(v) else v for c, v in row.items()}


def corner_fit(frequency: Column, ratio: Column, low_hz: float, high_hz: float, egf_corner: float) -> Column:
    """:func:`fit_corners` of arrays, over the usable band; rows of one length are fitted together."""

    @F.pandas_udf(_FIT)
    def run(f: pd.Series, r: pd.Series) -> pd.DataFrame:
        parts = []
        sizes = f.map(len).to_numpy()
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            for lo in range(0, len(rows), _FITS):
                at = rows[lo : lo + _FITS]
                x, y = (np.stack([np.asarray(v.iloc[k], float) for k in at]) for v in (f, r))
                fits = fit_corners(x, y, (x >= low_hz) & (x <= high_hz), egf_corner)
                parts.append(fits.set_index(at))
        fits = pd.concat(parts).sort_index() if parts else pd.DataFrame(columns=_FIT_COLUMNS)
        return fits.astype(object).where(fits.notna(), None)[_FIT_COLUMNS]

    return run(frequency, ratio)
