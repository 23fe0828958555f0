"""Caches written and read back, and what is in them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import detection
from quakeloom.operators.signal import resample_rows
from quakeloom.sources import caches


@pytest.fixture
def samples(spark):
    rows = [(e, k, (k - 40) / 40, c, math.sin(k * (c + 1) / 3 + e) * (3 if k >= 40 else 1) + 0.01 * ((k * 7 + c) % 11)) for e in (1, 2) for k in range(0 if e == 1 else 30, 120) for c in range(4)]
    return spark.createDataFrame(rows, "event_id int, sample int, t double, channel int, value double").repartition(3)


def test_event_cache_there_and_back(spark, samples, tmp_path):
    opts = detection.DetectionOptions(noise=(-1.0, 0.0), signal=(0.0, 2.0), block=2, rate_hz=40.0)
    caches.write_cache(caches.event_cache(samples, opts, 20.0), str(tmp_path))
    caches.write_cache(caches.event_cache(samples, opts, 20.0), str(tmp_path))
    got = caches.read_cache(spark, str(tmp_path))
    traces = {(r.event_id, r.channel): r for r in got["traces"].collect()}
    assert set(traces) == {(1, c) for c in range(4)}  # the other has too little noise
    for c in range(4):
        x = np.array([r.value for r in samples.filter((F.col("event_id") == 1) & (F.col("channel") == c)).orderBy("sample").collect()])
        r = traces[1, c]
        assert (r.display_rate_hz, r.first_t, r.last_t) == (20.0, -1.0, 79 / 40) and np.allclose(r["values"], resample_rows(x[None], 2)[0])
    assert got["channels"].count() == 4 and got["spectra"].filter("power_ratio > 1").count() > 0
    whole = caches.display_traces(samples, 40.0).filter("event_id = 1 and channel = 0").collect()[0]
    assert whole.display_rate_hz == 40.0 and len(whole["values"]) == 120
    with pytest.raises(Exception):
        caches.read_cache(spark, str(tmp_path / "none"))


def test_profiles_there_and_back(spark, tmp_path):
    channels = spark.createDataFrame([(e, c, float((c * e) % 5)) for e in (1, 2, 3) for c in range(6)], "event_id int, channel int, snr double")
    caches.write_cache(caches.profile_cache(channels), str(tmp_path))
    got = caches.read_cache(spark, str(tmp_path), caches.PROFILE_TABLES)
    assert got["profiles"].count() == 18 and got["profiles"].filter("log10_snr = -6").count() == 6
    m = {(r.a, r.b): r.spearman for r in got["spearman"].collect()}
    assert len(m) == 9 and m["1", "1"] == 1.0 and m["1", "2"] == m["2", "1"]
