"""Window reading against numpy over the same files, and each of its errors."""

import random

import numpy as np
import pytest

from quakeloom.sources.windows import FILE_SCHEMA, TRACE_SCHEMA, read_windows

SCALE = np.float32(2 * np.pi / 65536)


def recording(path, stamp, first_s, n, rate=100.0, locus=1800, unit="rad * 2PI/2^16", channels=2, step=0, late=0.0):
    times = [int(round((first_s + late + k / rate) * 1e6)) for k in range(n)]
    data = (np.arange(n * channels).reshape(n, channels) + step).astype(np.float32)
    return (path, stamp, rate, locus, unit, channels, times), data


def tables(spark, recordings):
    files = spark.createDataFrame([f for f, _ in recordings], FILE_SCHEMA).repartition(2)
    traces = spark.createDataFrame([(f[0], c, d[:, c].tolist()) for f, d in recordings for c in range(d.shape[1])], TRACE_SCHEMA).repartition(3)
    return files, traces


def read(spark, windows, recordings, **options):
    w = spark.createDataFrame(windows, "event_id string, start_s double, end_s double")
    heads, channels = read_windows(w, *tables(spark, recordings), **options)
    return {r.event_id: r for r in heads.collect()}, {(r.event_id, r.column_index): r for r in channels.collect()}


def test_a_window_over_two_files(spark):
    start = 1767225600.0
    pair = [recording("a", start, start, 100), recording("b", start + 1, start + 1, 100, step=1000)]
    heads, channels = read(spark, [("w", start + 0.5, start + 1.5)], pair)
    w = heads["w"]
    assert (w.error, w.samples, w.channels, w.source_files, w.unit) == (None, 100, 2, ["a", "b"], "processed_optical_phase_rad")
    assert w.missing_fraction == 0 and w.max_gap_s < 0.011 and w.epoch_s[0] == pytest.approx(start + 0.5)
    assert [channels["w", c].locus_index for c in (0, 1)] == [1800, 1801]
    for c in (0, 1):
        want = np.concatenate([pair[0][1][50:, c], pair[1][1][:50, c]]) * SCALE
        assert np.array_equal(np.array(channels["w", c]["values"], np.float32), want)


def plain(windows, recordings, first, last, stride):
    """One window at a time: files by name, samples by search, stable sort by time, first of equal times."""
    out = {}
    for event, start, end in windows:
        near = sorted(((f, d) for f, d in recordings if f[1] is not None and f[1] < end + 2 and f[1] + 62 > start), key=lambda x: (x[0][1], x[0][0]))
        parts = []
        for f, d in near:
            t = np.array(f[6]) * 1e-6
            a, b = np.searchsorted(t, start), np.searchsorted(t, end)
            if b > a:
                parts.append((t[a:b], d[a:b, first:last:stride] * (SCALE if "2PI" in f[4] else np.float32(1)), f[0]))
        if not parts:
            continue
        t, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(t, kind="stable")
        keep = np.concatenate([[True], np.diff(t[order]) > 0])
        out[event] = t[order][keep], x[order][keep], [p[2] for p in parts]
    return out


@pytest.mark.parametrize("first, last, stride", [(0, None, 1), (1, 5, 2), (2, 99, 3)])
def test_many_windows_over_overlapping_files(spark, first, last, stride):
    r = random.Random(first)
    files = [recording(f"f{k}", None if k == 7 else 10.0 * k + r.choice([-1.0, 0.0, 1.5]), 10.0 * k, r.choice([70, 100, 130, 104]), 10.0, 40, "counts", 6, k * 1000, r.choice([0, 0, 0.05, -0.2])) for k in range(25)]
    windows = [(f"w{k}", a := r.uniform(-5, 250), a + r.choice([0.01, 0.5, 7.0, 33.3])) for k in range(60)]
    heads, channels = read(spark, windows, files, first=first, last=last, stride=stride)
    want = plain(windows, files, first, last, stride)
    assert len(heads) == 60 and 20 < len(want) < 60
    for event, start, end in windows:
        w = heads[event]
        if event not in want:
            assert w.error in ("no file name intersects the window", "candidate files do not contain the window")
            continue
        t, x, sources = want[event]
        assert w.error is None and w.source_files == sources and np.array_equal(w.epoch_s, t) and w.samples == len(t)
        assert w.missing_fraction == pytest.approx(max(0.0, 1 - len(t) / max(1, round((end - start) * 10))))
        assert w.max_gap_s == pytest.approx(np.diff(t).max()) if len(t) > 1 else w.max_gap_s == float("inf")
        columns = list(range(6))[first:last:stride]
        assert w.channels == len(columns) and {c for e, c in channels if e == event} == set(columns)
        for k, c in enumerate(columns):
            assert channels[event, c].locus_index == 40 + c and np.array_equal(np.array(channels[event, c]["values"], np.float32), x[:, k])


@pytest.mark.parametrize("change, error", [
    ({"rate": 50.0}, "sample rate changes inside the window"), ({"channels": 3}, "channel columns change inside the window"),
    ({"locus": 1801}, "locus indices change inside the window"), ({"unit": "counts"}, "raw unit changes inside the window"),
])
def test_invariants_name_the_file(spark, change, error):
    files = [recording("a", 0.0, 0.0, 100), recording("b", 1.0, 1.0, 100, **change), recording("c", 2.0, 2.0, 100)]
    heads, channels = read(spark, [("over", 0.5, 1.5), ("before", 0.2, 0.9), ("alone", 1.0, 1.4)], files)
    assert heads["over"].error == f"{error}: b" and heads["over"].samples is None and heads["before"].error is None
    assert heads["alone"].error is None and {e for e, _ in channels} == {"before", "alone"}


def test_empty_windows_and_slices(spark):
    files = [recording("a", 0.0, 0.0, 100), recording("x", None, 50.0, 10)]
    heads, channels = read(spark, [("far", 500.0, 501.0), ("gap", 30.0, 31.0), ("back", 5.0, 5.0), ("ok", 0.0, 0.1)], files)
    assert {e: r.error for e, r in heads.items()} == {"far": "no file name intersects the window", "gap": "candidate files do not contain the window", "back": "a window must end after its start", "ok": None}
    assert {e for e, _ in channels} == {"ok"}
    heads, channels = read(spark, [("ok", 0.0, 0.1)], files, first=2)
    assert heads["ok"].error == "invalid channel slice 2:2 for 2 channels: a" and not channels
    for bad in ({"first": -1}, {"stride": 0}):
        with pytest.raises(ValueError):
            read(spark, [("ok", 0.0, 0.1)], files, **bad)
    assert read(spark, [("ok", 0.0, 0.1)], [recording("a", 0.0, 0.0, 1, unit="")])[0]["ok"].unit == "raw_counts_unknown_unit"
