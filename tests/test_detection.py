"""Detection of many events in one plan against numpy, one event at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import detection
from quakeloom.operators.signal import welch_rows

RATE = 40.0


def alone(t, x, opts):
    """One event's figures; x is samples by channels."""
    inside = lambda b: (t >= b[0]) & (t < b[1])
    noise, env = inside(opts.noise), np.sqrt((x**2).mean(axis=1))
    at = np.flatnonzero(inside(opts.search or opts.signal))
    if noise.sum() < int(opts.min_noise_s * RATE):
        return "too little noise"
    if not len(at):
        return "empty search window" if opts.search else "empty signal window"
    peak = at[env[at].argmax()]
    signal = inside((t[peak] - 0.25, t[peak] + 2.75) if opts.search else opts.signal)
    if signal.sum() < int(opts.min_signal_s * RATE):
        return "too little signal"

    def z(value, ref):
        scale = 1.4826 * np.median(np.abs(ref - np.median(ref)))
        return (value - np.median(ref)) / ((scale if scale > 2.3e-16 else ref.std()) + 2.220446049250313e-16)

    snr = np.sqrt((x[signal] ** 2).mean(axis=0)) / (np.sqrt((x[noise] ** 2).mean(axis=0)) + np.float32(1.1920929e-07))
    found = []
    for b in range(0, x.shape[1], opts.block):
        e = np.sqrt((x[:, b : b + opts.block] ** 2).mean(axis=1))
        found.append(z(e[signal].max(), e[noise]) >= opts.min_z)
    c = [np.corrcoef(x[signal, k], x[signal, k + 1])[0, 1] if x[signal, k].std() * x[signal, k + 1].std() > 0 else np.nan for k in range(x.shape[1] - 1)]
    n = min(opts.nperseg, noise.sum(), signal.sum())
    f, s = welch_rows(x[signal].T, RATE, n)
    ratio = np.median(s, axis=0) / (np.median(welch_rows(x[noise].T, RATE, n)[1], axis=0) + 1.1920929e-07)
    ok = np.flatnonzero(ratio >= opts.min_ratio)
    runs = [r for r in np.split(ok, np.flatnonzero(np.diff(ok) > 1) + 1) if len(r) >= 2]
    return (t[peak], z(env[peak], env[noise]), np.median(snr), np.percentile(snr, 10), np.mean(found), np.nanmedian(c), np.nanmedian(np.abs(c)), [[f[r[0]], f[r[-1]]] for r in runs])


@pytest.mark.parametrize("opts", [
    detection.DetectionOptions(noise=(-2.0, 0.0), signal=(0.0, 3.0), block=2, min_z=4.0, min_fraction=0.3, rate_hz=RATE, nperseg=32, min_ratio=3.0),
    detection.DetectionOptions(noise=(-2.0, 0.0), signal=None, search=(0.0, 2.0), block=3, min_z=4.0, min_fraction=0.3, rate_hz=RATE, nperseg=64, min_ratio=3.0),
])
def test_a_thousand_events_in_one_plan(spark, opts):
    rng, events = np.random.default_rng(1), {}
    for k in range(1000):
        first, last = (-2.0, 4.0) if k % 50 else [(-0.5, 4.0), (-2.0, -0.1), (-2.0, 0.3)][k // 50 % 3]
        t = np.arange(round(first * RATE), round(last * RATE)) / RATE
        x = rng.normal(size=(len(t), 5))
        hit = np.flatnonzero(t >= 0.7)
        if k % 3 == 0 and len(hit):
            x[hit] += 8 * np.exp(-t[hit] + 0.7)[:, None] * np.sin(2 * np.pi * 5 * t[hit])[:, None]
        if k % 7 == 0:
            x[:, 3] = 0.0
        events[k] = t, x
    rows = [(k, float(a), i, row.tolist()) for k, (t, x) in events.items() for i, (a, row) in enumerate(zip(t, x))]
    df = spark.createDataFrame(rows, "event_id long, t double, sample int, v array<double>").select("event_id", "sample", "t", F.posexplode("v").alias("channel", "value"))
    got = {r.event_id: r for r in detection.detect_events(df, opts).collect()}
    assert len(got) == 1000 and {r.status for r in got.values()} == {"PASS", "STOP", "ERROR"}
    for k, (t, x) in events.items():
        want, r = alone(t, x, opts), got[k]
        if isinstance(want, str):
            assert (r.error, r.status, r.peak_robust_z, r.detected, r.usable_power_snr_ranges_hz) == (want, "ERROR", None, None, None)
            continue
        have = (r.peak_t, r.peak_robust_z, r.median_channel_snr, r.p10_channel_snr, r.detected_block_fraction, r.median_adjacent_correlation, r.median_absolute_adjacent_correlation)
        assert r.error is None and have == pytest.approx(want[:7], rel=1e-9, abs=1e-9), k
        assert np.allclose(r.usable_power_snr_ranges_hz, want[7]) and len(r.usable_power_snr_ranges_hz) == len(want[7])
        assert r.detected == (want[1] >= opts.min_z and want[4] >= opts.min_fraction) and r.status == ("PASS" if r.detected else "STOP")


def test_rates_and_empty_tables(spark):
    opts = detection.DetectionOptions(noise=(-1.0, 0.0), signal=(0.0, 1.0), rate_hz=10.0)
    rows = [(e, k, k / 10, c, float((k * 7 + c) % 5), 10.0 if e == 1 or k < 0 else 20.0) for e in (1, 2) for k in range(-12, 12) for c in (0, 1)]
    df = spark.createDataFrame(rows, "event_id int, sample int, t double, channel int, value double, rate_hz double")
    assert {r.event_id: r.error for r in detection.detect_events(df, opts).collect()} == {1: None, 2: "sample rate changes within the event"}
    assert detection.detect_events(df.filter("false"), opts).count() == 0
    with pytest.raises(ValueError):
        detection.detect_events(df, detection.DetectionOptions(signal=None))
