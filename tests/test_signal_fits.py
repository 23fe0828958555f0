"""Fits of many spectral ratios at once against one at a time by an independent search."""

import numpy as np

from quakeloom.operators.signal import fit_corner, fit_corners


def cost(p, f, y, egf):
    r = p[0] + np.log1p((f / egf) ** 2) - np.log1p((f / np.exp(p[1])) ** 2) - y
    return r @ r


def test_many_noisy_fits():
    rng = np.random.default_rng(1)
    f = np.tile(np.linspace(2.0, 80.0, 150), (300, 1))
    true = rng.uniform(4, 70, 300)
    level = np.exp(rng.normal(0, 1, 300))
    ratio = level[:, None] * (1 + (f / 45) ** 2) / (1 + (f / true[:, None]) ** 2) * np.exp(rng.normal(0, 0.3, f.shape))
    ratio[5, 3], ratio[6, 4], ratio[7] = np.nan, -1.0, 0.0
    usable = (f >= 5) & (f <= 60) & (rng.random(f.shape) < 0.9)
    usable[8, 12:] = False
    fits = fit_corners(f, ratio, usable, 45.0)
    assert list(fits.reason[[7, 8]]) == ["too few usable spectral points"] * 2 and fits.points[7] == 0 and np.isnan(fits.min_hz[7])
    for k in range(300):
        if k in (7, 8):
            continue
        use = usable[k] & np.isfinite(ratio[k]) & (ratio[k] > 0)
        x, y = f[k, use], np.log(ratio[k, use])
        best = np.log([fits.omega_ratio[k], fits.corner_hz[k]])
        here = cost(best, x, y, 45.0)
        # no corner within the bounds, each with its best level, is better
        grid = np.linspace(np.log(x.min() / 10), np.log(x.max() * 10), 800)
        for c in grid:
            d = np.log1p((x / 45.0) ** 2) - np.log1p((x / np.exp(c)) ** 2) - y
            assert here <= ((d - d.mean()) ** 2).sum() + 1e-9
        assert fits.points[k] == use.sum() and np.isclose(fits.variance[k], here / (use.sum() - 2))
        alone = fit_corner(f[k], ratio[k], usable[k], 45.0)
        assert np.isclose(alone["corner_hz"], fits.corner_hz[k], rtol=1e-9) and alone["status"] == fits.status[k]
    assert {"PASS", "STOP"} == set(fits.status)


def test_no_points_at_all():
    empty = fit_corner(np.zeros(0), np.zeros(0), np.zeros(0, bool), 45.0)
    assert empty["status"] == "STOP" and empty["points"] == 0 and empty["min_hz"] is None
    assert fit_corner(np.arange(1.0, 6), np.ones(5), np.ones(5, bool), 45.0)["reason"] == "too few usable spectral points"
