"""Filters, tapers and whole comparisons against plain numpy written apart from the library."""

from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from quakeloom.operators import signal

SF, FS = "/root/testdata/sf0.001", 100.0


def transfer(low, high, fs, order=4):
    """Numerator and denominator of a Butterworth band-pass: poles on a circle, moved to the band, mapped to the unit disc."""
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    width, centre = warp(high) - warp(low), np.sqrt(warp(low) * warp(high))
    circle = [np.exp(1j * np.pi * (0.5 + (2 * k + 1) / (2 * order))) for k in range(order)]
    poles = np.concatenate([np.roots([1, -p * width, centre**2]) for p in circle])
    z = (2 * fs + poles) / (2 * fs - poles)
    a, b = np.poly(z).real, np.poly([1.0] * order + [-1.0] * order).real
    w = np.exp(-1j * 2 * np.arctan(centre / (2 * fs)) * np.arange(2 * order + 1))
    return b / abs((b @ w) / (a @ w)), a


def once(b, a, x):
    """One pass by the difference equation, as if the first sample had lasted for ever."""
    n = len(a) - 1
    steady = b.sum() / a.sum()
    past_x, past_y = [x[0]] * n, [steady * x[0]] * n
    out = []
    for v in x:
        y = b[0] * v + sum(b[k + 1] * past_x[k] - a[k + 1] * past_y[k] for k in range(n))
        past_x, past_y = [v, *past_x[:-1]], [y, *past_y[:-1]]
        out.append(y)
    return np.array(out)


def both_ways(x, low, high, fs):
    b, a = transfer(low, high, fs)
    pad = 27
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return once(b, a, once(b, a, ext)[::-1])[::-1][pad:-pad]


def vectors(spark):
    return {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def test_bandpass_of_every_vector(spark):
    own = vectors(spark)
    got = {r.vec_id: r.filtered for r in entry.queries()["bandpass"](spark, SF).collect()}
    assert got.keys() == own.keys()
    for k in list(own)[::7]:
        assert np.allclose(got[k], both_ways(own[k], 5.0, 20.0, FS), atol=1e-9)


def test_tapers_are_the_most_concentrated_sequences(spark):
    n, bandwidth = 64, 3.5
    m = n + 1
    d = np.arange(m)[:, None] - np.arange(m)[None, :]
    w = bandwidth / m
    kernel = np.where(d == 0, 2 * w, np.sin(2 * np.pi * w * d) / (np.pi * np.where(d == 0, 1, d)))
    values, sequences = np.linalg.eigh(kernel)
    best = sequences[:, ::-1][:, :5].T[:, :-1]
    assert values[-5] > 0.9
    own = vectors(spark)
    got = {r.vec_id: r.amplitude for r in entry.queries()["multitaper"](spark, SF).collect()}
    for k in list(own)[::29]:
        x = own[k] - own[k].mean()
        power = [np.abs(np.fft.rfft(t * x)) ** 2 for t in best]
        assert np.allclose(got[k], np.sqrt(np.mean(power, axis=0)), atol=1e-6)


def test_resampled_vectors(spark):
    own = vectors(spark)
    got = {r.vec_id: r.resampled for r in entry.queries()["resample"](spark, SF).collect()}
    taps = np.array([np.sinc(t / 2) / 2 * np.i0(5.0 * np.sqrt(1 - (t / 20) ** 2)) for t in range(-20, 21)])
    taps /= taps.sum()
    for k, x in own.items():
        want = [sum(taps[t + 20] * x[j + t] for t in range(-20, 21) if 0 <= j + t < len(x)) for j in range(0, len(x), 2)]
        assert np.allclose(got[k], want, atol=1e-9)


BANDS = ((5.0, 20.0), (10.0, 40.0))


def compared(own):
    """(event, trace, band): SNR of both, greatest correlation within five samples, its lag; every event against event 0."""
    parts = {}
    for k, x in own.items():
        for low, high in BANDS:
            s, n = both_ways(x[32:62], low, high, FS), both_ways(x[2:32], low, high, FS)
            snr = np.sqrt((s**2).mean()) / (np.sqrt((n**2).mean()) + 2.220446049250313e-16)
            parts[k // 10, k % 10, f"{low}-{high}Hz"] = s, snr
    out = {}
    for (event, trace, band), (y, snr) in parts.items():
        if event and (0, trace, band) in parts:
            x, first = parts[0, trace, band]
            a, b = x - x.mean(), y - y.mean()
            full = np.correlate(a, b, "full") / np.sqrt((a @ a) * (b @ b))
            near = full[len(a) - 1 - 5 : len(a) + 5]
            out[str(event), trace, band] = first, snr, near.max(), (int(near.argmax()) - 5) / FS
    return out


@pytest.fixture(scope="module")
def metrics(spark):
    return compared(vectors(spark))


def test_pair_metrics_of_every_event(spark, metrics):
    rows = entry.queries()["waveform_pair_metrics"](spark, SF).collect()
    assert len(rows) == len(metrics)
    for r in rows:
        first, second, c, lag = metrics[r.b, int(r.station) * 2 + int(r.component), r.band]
        assert (r.reference_snr, r.comparison_snr, r.correlation) == pytest.approx((first, second, c), abs=1e-7)
        assert r.lag_s == pytest.approx(lag) and r.usable == (min(first, second) >= 0.5) and r.a == "0"


def test_shortlist_scored_against_one_anchor(spark, metrics):
    by_event = defaultdict(list)
    for (event, trace, band), (first, second, c, _) in metrics.items():
        if min(first, second) >= 0.5:
            by_event[event].append((band, trace // 2, c))
    rows = {r.event_id: r for r in entry.queries()["single_anchor_scoring"](spark, SF).collect()}
    events = {str(k // 10) for k in vectors(spark)}
    assert rows.keys() == events and rows["0"].decision == "seed"
    for event in events - {"0"}:
        found, r = by_event[event], rows[event]
        bands = [[x for x in found if x[0] == f"{a}-{b}Hz"] for a, b in BANDS]
        components, stations = min(map(len, bands)), min(len({x[1] for x in b}) for b in bands)
        assert (r.minimum_components_per_band, r.minimum_stations_per_band, r.usable_metric_count) == (components, stations, len(found))
        enough = components >= 1 and stations >= 1
        assert r.status == ("PASS" if enough else "STOP")
        if found:
            assert r.overall_median_correlation == pytest.approx(np.median([x[2] for x in found]), abs=1e-7)
        family = enough and np.median([x[2] for x in found]) >= 0.85 and min(np.median([x[2] for x in b]) for b in bands) >= 0.75
        assert r.decision == ("family" if family else "not_family" if enough else "insufficient_data")


def test_filter_rows_together_or_alone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 80))
    together = signal.bandpass_rows(x, 3.0, 30.0, FS)
    assert all(np.allclose(together[k], both_ways(x[k], 3.0, 30.0, FS), atol=1e-9) for k in range(5))
