"""The kernels against planted truth, other forms of the same thing, or numeric derivatives."""

import numpy as np
import pytest

from voxelane.functions import demix as X
from voxelane.functions import denoise as N
from voxelane.functions import factor as K
from voxelane.functions import lstm as L
from voxelane.functions import optics as O
from voxelane.functions import register as R
from voxelane.functions import signal as G

rng = np.random.default_rng(0)


def response(filter_, f, n=8192):
    """The gain of a causal filter at a frequency in cycles a sample."""
    h = np.fft.rfft(filter_(np.r_[1.0, np.zeros(n - 1)]))
    return abs(h[int(round(f * n))])


def test_butterworth_gains():
    half = np.sqrt(0.5)
    for order in (2, 5, 6):
        assert response(lambda y: G.lowpass(y, 0.3, order), 0.15) == pytest.approx(half, rel=1e-3)
        assert response(lambda y: G.lowpass(y, 0.3, order), 0.0) == pytest.approx(1)
        f = 0.22
        want = 1 / np.sqrt(1 + (np.tan(np.pi * f) / np.tan(np.pi * 0.15)) ** (2 * order))
        assert response(lambda y: G.lowpass(y, 0.3, order), f) == pytest.approx(want, rel=1e-2)
        band = lambda y: G.bandpass(y, 0.1, 0.4, order)  # noqa: B023, E731
        assert response(band, 0.05) == pytest.approx(half, rel=1e-2) and response(band, 0.2) == pytest.approx(half, rel=1e-2)
        a, b = np.tan(np.pi * 0.05), np.tan(np.pi * 0.2)
        for f in (0.03, 0.1, 0.3):
            w = np.tan(np.pi * round(f * 8192) / 8192)
            assert response(band, f) == pytest.approx(1 / np.sqrt(1 + ((w * w - a * b) / ((b - a) * w)) ** (2 * order)), rel=1e-3)


def test_zero_phase_high_pass():
    assert np.abs(G.highpass_zero_phase(np.full(300, 100.0), 0.02)).max() < 1e-6
    t = np.arange(4000)
    y = np.sin(2 * np.pi * 0.1 * t)
    out = G.highpass_zero_phase(np.stack([y + 50, y - 3]), 0.02)
    assert np.allclose(out[:, 500:-500], y[500:-500], atol=1e-3)


def test_stacks_filter_like_single_traces():
    y = rng.normal(size=(5, 60))
    for f in (lambda x: G.lowpass(x, 0.3), lambda x: G.bandpass(x, 0.1, 0.4), lambda x: G.highpass_zero_phase(x, 0.2)):
        assert np.allclose(f(y), np.stack([f(x) for x in y]))


def test_savgol_fits_local_polynomials():
    y = rng.normal(size=40)
    out, x = G.savgol(y, 11, 3), np.arange(11)
    for t in (0, 3, 20, 37, 39):
        a = min(max(0, t - 5), 29)
        assert out[t] == pytest.approx(np.polyval(np.polyfit(x, y[a : a + 11], 3), t - a))


def test_convolutions():
    y = rng.normal(size=200)
    h = G.fir_kaiser(np.r_[1.0, np.zeros(199)], 100.0, 20.0)
    assert h.sum() == pytest.approx(1) and np.allclose(G.fir_kaiser(y, 100.0, 20.0), np.convolve(y, h)[:200])
    assert np.allclose(G.gaussian_band(np.full(80, 7.0), 11, 2.0)[10:-10], 0)
    w = G.lanczos_weights(9, 0.2)
    assert np.allclose(w, w[::-1]) and w[len(w) // 2] == pytest.approx(0.4)


@pytest.mark.parametrize("estimator", ["welch", "fft", "boot"])
def test_noise_estimators(estimator):
    y = rng.normal(0, 3.0, (4, 4000))
    assert np.allclose(G.estimate_noise(y, estimator, "mean"), 3, rtol=0.1)
    with pytest.raises(ValueError):
        G.estimate_noise(y, "other")


def test_splines():
    y = np.cumsum(rng.normal(size=400))
    basis = G.spline_basis(400, 50)
    assert np.allclose(basis.sum(1), 1)
    fit = G.spline_trend(y, 50, robust=False)
    assert np.allclose(basis.T @ (y - fit), 0, atol=1e-6)  # normal equations
    spiky = np.sin(np.arange(400) / 60)
    spiky[::50] += 30
    assert np.abs(G.spline_trend(spiky, 100) - np.sin(np.arange(400) / 60)).max() < 0.1


def test_trends_that_follow_a_stimulus():
    t = np.arange(1200)
    stim = ((t >= 400) & (t < 700)).astype(float)
    y = 0.01 * t + 0.05 * np.clip(t - 400, 0, 300) + 8 * (t >= 900)
    trend = G.stimulus_trend(y, stim, np.array([900]))
    assert np.abs(trend - y).max() < 0.5 < np.abs(G.spline_trend(y, 250) - y).max()
    left, _, s, places = G.without_jumps(y, trend, stim, np.array([900]))
    assert len(left) == len(s) == 1197 and set(places) >= {400, 700}
    bleach = 3 - 0.002 * t + 1e-6 * t**2
    more, keep = G.retrend(bleach + 5 * stim, np.array([900]), stim)
    assert np.allclose(more[:800], 5 * stim[:800], atol=1e-6) and not keep[897:904].any() and keep.sum() == 1193


def test_trend_filter_meets_its_conditions():
    y, weight = np.cumsum(rng.normal(size=150)), 4.0
    w = G.trend_filter(y, weight, 4000)
    d = np.diff(np.eye(150), 2, axis=0)
    s = np.linalg.lstsq(d.T, -2 * (w - y) / weight, rcond=None)[0]
    assert np.abs(d.T @ s * weight + 2 * (w - y)).max() < 1e-8 and np.abs(s).max() < 1 + 1e-4
    bent = np.abs(d @ w) > 1e-3
    assert np.abs(s[bent]).min() > 1 - 1e-3
    banded = G._curved(150, 2.5)
    assert np.allclose(banded.solve(y), np.linalg.solve(2 * np.eye(150) + 2.5 * d.T @ d, y))


def test_constrained_trend_and_regions():
    t = np.arange(600)
    clean = np.abs((t % 200) - 100) / 10.0
    y = clean + rng.normal(0, 0.5, 600)
    w = G.constrained_trend(y, 0.5)
    assert np.sqrt(((y - w) ** 2).mean()) <= 0.5 and ((w - clean) ** 2).mean() < 0.25 * ((y - clean) ** 2).mean()
    spikes = rng.normal(size=3000)
    spikes[1000:1004] += 40
    regions, factors = G.detect_regions(spikes, 1.0, gap=50, buffer=20, discount=0.5)
    assert np.array_equal(np.concatenate(regions), np.arange(3000)) and factors.tolist() == [1, 0.5, 1]
    assert 980 <= regions[1][0] <= 1000 and 1003 < regions[1][-1] <= 1030
    out = G.constrained_trend_in_regions(spikes, 1.0, 6, gap=50, buffer=20)
    assert len(out) == 3000 and np.isfinite(out).all()


def test_rank_tests():
    v = np.stack([np.sin(np.arange(300) / 9), rng.normal(size=300), np.r_[50.0, rng.normal(size=299)], np.cos(np.arange(300) / 30)])
    assert G.choose_rank(v, 5, 3.0).tolist() == [0, 3]
    assert G.choose_rank(v, 5, 3.0, ordered=True).tolist() == [0]
    assert 2 in G.choose_rank(v, 5, 3.0, by_kurtosis=True) and G.choose_rank(v[1:2], 5, 3.0, min_rank=1).tolist() == [0]


def test_wiener_and_low_rank():
    m = rng.normal(size=(6, 40))
    u, s, v = K.svd(m)
    assert np.allclose((u * s) @ v, m) and np.allclose(K.low_rank(m, 6), m)
    assert np.linalg.matrix_rank(K.block_pca(m)) == 1
    shared = np.sin(np.arange(400) / 15)
    movie = np.broadcast_to(shared, (5, 5, 400)) + rng.normal(0, 0.5, (5, 5, 400))
    out = K.wiener(movie, np.full((5, 5), 0.5))
    assert ((out - shared) ** 2).mean() < 0.5 * ((movie - shared) ** 2).mean()


def blobs(noise=0.05, n=300):
    x, y = np.meshgrid(np.arange(20), np.arange(24), indexing="ij")
    places = [(5, 5), (14, 9), (8, 18)]
    a = np.stack([np.exp(-((x - p) ** 2 + (y - q) ** 2) / 8).ravel() * (np.hypot(x - p, y - q) < 4).ravel() for p, q in places], 1)
    c = np.maximum(0, rng.normal(0, 1, (n, 3))) * (rng.random((n, 3)) < 0.15) * 4
    c = np.stack([np.convolve(t, np.exp(-np.arange(20) / 5))[:n] for t in c.T], 1)
    return a, c, (a @ c.T + 1 + rng.normal(0, noise, (480, n))).reshape(20, 24, n)


def matched(found, truth):
    r = np.corrcoef(found.T, truth.T)[: found.shape[1], found.shape[1] :]
    return r.max(0)


def test_demixing_finds_planted_cells():
    a, c, movie = blobs()
    cells = X.demix(movie, [0.7, 0.6], [8, 8], [2, 1], [0.6, 0.6], 0.3, (10, 12), rounds=12, last_rounds=16)
    assert cells.a.shape[1] == 3
    assert matched(cells.c, c).min() > 0.9 and matched(cells.a, a).min() > 0.9
    assert np.allclose((cells.a**2).sum(0), 1) and cells.a.min() >= 0 and cells.c.min() >= 0
    more = X.demix(movie, [0.7], [8], [2], [0.6], 0.3, background=1, last_rounds=8)
    assert more.a.shape[1] == 3 and more.ff.shape == (300, 1) and np.allclose(more.ff.mean(0), 0)
    again, back, left = X.recompute(movie, cells)
    assert matched(again.T, c).min() > 0.9 and np.allclose(left.mean(1), 0)
    none = X.demix(np.zeros((6, 6, 40)), [0.7], [4], [1], [0.6])
    assert none.a.shape == (36, 0) and none.c.shape == (40, 0)


def test_steps_of_demixing():
    x, beta = rng.random((30, 3)), rng.random((3, 7))
    u = x @ beta
    got = np.zeros((3, 7))
    for _ in range(3000):
        got = X.descend(x, u, got)
    assert np.allclose(got, beta, atol=1e-3)
    masked = X.descend(x, u, np.zeros((3, 7)), np.array([[1] * 7, [0] * 7, [1] * 7]))
    assert not masked[1].any() and masked[0].any()
    assert (X.descend(x, -u, np.zeros((3, 7)), None, 1)[:2] == 0).all() and (X.descend(x, -u, np.zeros((3, 7)), None, 1)[2] < 0).all()
    corr = np.zeros((100, 1))
    corr.reshape(10, 10)[2:5, 2:5] = 0.8
    corr.reshape(10, 10)[7:9, 7:9] = 0.9
    mask = np.zeros((100, 1))
    mask.reshape(10, 10)[3:5, 3:5] = 1
    assert np.array_equal(np.flatnonzero(X.supports(corr, mask, (10, 10), 0.95)[:, 0]), np.flatnonzero(corr[:, 0] == 0.8))
    a, c = np.zeros((100, 2)), np.abs(rng.normal(size=(50, 1)))
    a[20:40, 0] = a[22:42, 1] = 1
    m = a.sum(1)[:, None] * c.T
    joined = X.merged(a, np.hstack([c, c]), (a > 0) * 1.0, m, 0.5, 0.7)
    assert joined[0].shape[1] == 1 and np.allclose(joined[0] @ joined[1].T, m, atol=1e-6)
    assert X.merged(a, np.hstack([c, c]), (a > 0) * 1.0, m, 0.5, 0.99) is None
    assert X.without(X.Cells(a, np.hstack([c, c]), c), np.array([True, False])).a.shape[1] == 1


def test_superpixels_and_pure_columns():
    a, c, movie = blobs(0.01)
    groups = X.superpixels(X.threshold(movie.reshape(480, -1), 2), (20, 24), 0.8, 5)
    assert len(groups) == 3
    base = np.abs(rng.normal(size=(40, 3)))
    mix = base @ np.abs(rng.normal(size=(3, 6)))
    m = np.hstack([mix[:, :3], base, mix[:, 3:]])
    assert sorted(K.pure_columns(m, 0.05, 9)) == [3, 4, 5]
    assert K.pure_columns(np.zeros((4, 2)), 0.1, 2) == []


def test_factorisations():
    a, c = rng.random((30, 3)), rng.random((3, 50))
    m = a @ c
    for rule in ("hals", "mu"):
        b, d = K.nmf(m, a + rng.random(a.shape) * 0.3, c + rng.random(c.shape) * 0.3, 400, rule)
        assert np.linalg.norm(m - b @ d) < 0.05 * np.linalg.norm(m) and b.min() >= 0 and d.min() >= 0
    u, v = K.rank1(np.outer(a[:, 0], c[0]))
    assert np.allclose(np.outer(u, v), np.outer(a[:, 0], c[0]))
    assert np.allclose(K.unmix(m, a), c)
    truth, traces, movie = blobs(0.0)
    got = K.hals(movie, truth * 0.9, traces.T * 0.8 + 0.01, np.ones((480, 1)), np.ones((1, 300)), 3, 8)
    model = got[0] @ got[1] + got[2] @ got[3]
    assert np.linalg.norm(model - movie.reshape(480, -1)) < 0.02 * np.linalg.norm(movie)


def test_factorisation_keeps_to_its_support_in_each_step():
    own = np.random.default_rng(0)
    s, c = own.random((20, 3)) < 0.6, own.random((3, 40)) + 1
    m = (own.random((20, 3)) * s) @ c + own.normal(0, 0.05, (20, 40))
    start = own.random((20, 3))
    off = []
    for rounds in range(1, 5):
        b, d = K.nmf(m, start, c, rounds, support=s)
        assert not b[~s].any()
        off.append(np.linalg.norm(m - b @ d))
    assert off[0] < 0.15 * np.linalg.norm(m) and all(y <= x + 1e-9 for x, y in zip(off, off[1:]))


def test_traces_of_cells_in_a_block():
    a, c, movie = blobs(0.0)
    mask = np.zeros((20, 24), bool)
    mask[:, :14] = True
    kept, traces, inside, masked = X.cell_traces(movie - 1, np.hstack([a, np.zeros((480, 1))]), mask)
    assert np.allclose(traces.T, c) and kept.shape == (480, 3) and inside.shape[1] == 2 and len(masked) == 2
    assert X.cell_traces(movie, a * 0, mask)[1].shape == (0, 300) and X.cell_traces(movie, a, mask & False)[3].shape == (0, 300)


def test_noise_cost_has_its_gradient():
    u, extra, mask = rng.random((6, 6)) + 0.5, rng.random((6, 6)) * 0.2, rng.random((6, 6))
    mask = (mask + np.roll(mask[::-1, ::-1], (1, 1), (0, 1))) / 2  # a filter of real images
    value, g = K.noise_cost(u, u + 0.1, extra, mask, 0.7)
    for i, j in ((0, 0), (2, 3), (5, 1)):
        h = u.copy()
        h[i, j] += 1e-5
        assert (K.noise_cost(h, u + 0.1, extra, mask, 0.7)[0] - value) / 1e-5 == pytest.approx(g[i, j], rel=1e-3, abs=1e-4)
    x = K.noise_corrected(u, np.full((6, 6), 0.1), np.ones((6, 6)), mask, 0.7)
    g = K.noise_cost(x, u, np.full((6, 6), 0.1), mask, 0.7)[1]
    assert np.abs(g[x > 1e-6]).max() < 2e-2 and (g[x <= 1e-6] > -1e-3).all()
    assert K.noise_corrected(u, np.zeros((6, 6)), np.ones((6, 6)), mask, 1.0) is u


def test_tiles_filters_and_reduction():
    image = rng.random((12, 12))
    parts = O.tiles_with_margin(image, 4)
    assert parts.shape == (9, 6, 6) and np.array_equal(O.stitched(parts), image)
    assert np.array_equal(O.tiles(image, 4)[1], image[4:8, :4]) and np.array_equal(parts[4][1:-1, 1:-1], image[4:8, 4:8])
    b, step = O.bridged(image, 3, 0), (image[-1] - image[0]) / 7
    assert np.allclose(b[:3], [image[0] + k * step for k in (1, 3, 2)]) and np.allclose(b[15:], [image[0] + k * step for k in (4, 5, 6)])
    assert O.bridged(image, 2).shape == (16, 16)
    spread, _, transfer = O.point_spread(32, 0.1, 1.2, 0.6)
    assert spread.sum() == pytest.approx(1) and transfer.max() == 1 and O.radius(4, 0.5)[2, 2] == 0
    for kind in ("pure", "weighted", "adjustable"):
        f = O.high_pass(32, 0.1, 1.2, 0.6, kind)
        assert f[16, 16] == 0 and 0 <= f.min() and f.max() <= 1 and f[0, 0] > f[16, 18]
    with pytest.raises(ValueError):
        O.roll_off("other", 1, 1)
    clean = 20 + 10 * np.sin(np.arange(24) / 6)[:, None] * np.cos(np.arange(20) / 5)
    noisy = clean + rng.normal(0, 4, clean.shape)
    out = O.reduce_noise(noisy, np.full(clean.shape, 16.0), np.ones(clean.shape), 12, 0.1, 1.2, 0.6, 0.5)
    assert out.shape == clean.shape and ((out - clean) ** 2).mean() < 0.7 * ((noisy - clean) ** 2).mean()
    image, kernel = O.ideal_image(rng.random(50) * 90, rng.random(50) * 90, 16, 0.1, 2, 1.2, 0.6)
    assert image.shape == (16, 16) and kernel.shape == (10, 10) and image.min() >= 0


def picture(shape, seed=3):
    return R.blur(np.random.default_rng(seed).normal(size=shape), 3.0)


def test_splines_resample_exactly_at_samples():
    image = picture((15, 40))
    assert np.allclose(R.apply(image, np.eye(3)), image)
    shift = np.eye(3)
    shift[0, 2] = 2
    assert np.allclose(R.apply(image, shift)[:13], image[2:]) and (R.apply(image, shift)[13:] == 0).all()
    x = np.linspace(0, 3, 60)
    wave = np.sin(x)[:, None] * np.ones(8)
    shift[0, 2] = 0.5
    assert np.abs(R.apply(wave, shift)[8:50, 4] - np.sin(x[8:50] + 0.5 * (x[1] - x[0]))).max() < 1e-6
    volume = picture((6, 10, 12))
    assert np.allclose(R.apply(volume, np.eye(4)), volume)
    m = np.array([[1.0, 0.25, 3], [0, 1, -2], [0, 0, 1]])
    assert np.array_equal(R.from_text(R.to_text(m)), m)


@pytest.mark.parametrize("kind", ["translation", "rigid", "affine"])
def test_registration_of_planes(kind):
    fixed = picture((48, 56))
    p = {"translation": [2.3, -1.7], "rigid": [1.5, -2.2, 0.05], "affine": [1.0, -1.5, 0.04, 0.03, -0.02, -0.03]}[kind]
    truth = R.matrix_of(kind, np.array(p), fixed.shape)
    moving = R.apply(fixed, np.linalg.inv(truth))
    found = {"translation": R.translation2d, "rigid": R.rigid2d, "affine": R.affine2d}[kind](fixed, moving)
    corners = np.array([[8, 8, 1], [40, 8, 1], [8, 48, 1], [40, 48, 1.0]]).T
    assert np.abs((found - truth) @ corners).max() < 0.6


def test_registration_of_volumes():
    fixed = picture((12, 32, 36), 5)
    truth = R.matrix_of("rigid", np.array([0.8, 1.6, -1.2, 0.0, 0.0, 0.04]), fixed.shape)
    moving = R.apply(fixed, np.linalg.inv(truth))
    corners = np.array([[3, 6, 6, 1], [8, 26, 6, 1], [3, 6, 30, 1], [8, 26, 30, 1.0]]).T
    for f, near in ((R.rigid3d, 0.7), (R.rigid_in_planes, 0.9), (R.affine3d, 0.9)):
        assert np.abs((f(fixed, moving) - truth) @ corners).max() < near
    flat = R.rigid_projected(fixed, moving)
    assert flat[0].tolist() == [1, 0, 0, 0]
    shifted = R.apply(fixed, np.linalg.inv(R.matrix_of("translation", np.array([1.2, -2.0, 1.0]), fixed.shape)))
    assert np.abs(R.translation3d(fixed, shifted)[:3, 3] - [1.2, -2.0, 1.0]).max() < 0.5


def test_sparse_footprints():
    v, y = rng.normal(size=(4, 60)), None
    truth = np.array([2.0, 0, 0, -1])
    y = truth @ v + rng.normal(0, 0.1, 60)
    u = N.lasso(y, v, 3.0)
    g = 2 * v @ (u @ v - y)
    assert np.allclose(g[u != 0], -3 * np.sign(u[u != 0]), atol=1e-5) and (np.abs(g[u == 0]) <= 3 + 1e-6).all()
    assert np.allclose(N.lasso(y, v, 0.0), np.linalg.lstsq(v.T, y, rcond=None)[0], atol=1e-5)
    s, weight = N.sparse_footprint(y, v, 0.2)
    assert weight > 0 and np.sqrt(((y - s @ v) ** 2).mean()) <= 0.2 and np.abs(s).sum() < 3.0
    assert N.sparse_footprint(y, v, 1e-6)[1] == 0 and not N.sparse_footprint(y, v, 100.0)[0].any()


def test_greedy_components_lower_the_error():
    t = np.arange(240)
    truth = np.outer(rng.random(25), np.abs((t % 120) - 60) / 20.0) + np.outer(rng.random(25), np.sin(t / 25) * 2)
    truth -= truth.mean(1, keepdims=True)
    m = truth + rng.normal(0, 0.6, truth.shape)
    u, v = N.greedy(m, most=5, turns=2)
    assert 1 <= len(v) <= 3 and ((u @ v - truth) ** 2).mean() < 0.5 * ((m - truth) ** 2).mean()
    for how in ({}, {"greedy_": True}, {"every": 2}, {"scale": True}):
        out, rank = N.denoise_patch(m + 5, **how)
        assert rank >= 1 and ((out - 5 - truth) ** 2).mean() < 0.6 * ((m - truth) ** 2).mean()
    assert N.denoise_patch(np.full((4, 30), 2.0))[1] == 0
    e, bend, flat = N.cost(m, u, v, 1.0, 1.0)
    assert e == pytest.approx(((m - u @ v) ** 2).sum()) and bend > 0 and flat > 0
    after = N.update_traces(m, u, v, 0.0)
    assert N.cost(m, u, after)[0] <= e + 1e-9


def test_greedy_takes_all_components_that_pass():
    t = np.arange(240)
    traces = np.stack([np.cos(np.pi * (t + 0.5) * k / 240) for k in range(1, 25)])  # as many smooth traces as no limit should cut
    m = np.linalg.qr(rng.normal(size=(30, 24)))[0] * np.linspace(60, 30, 24) @ traces + rng.normal(0, 0.05, (30, 240))
    m -= m.mean(1, keepdims=True)
    assert len(N.greedy(m, turns=0)[1]) >= 24 and len(N.greedy(m, most=3, turns=0)[1]) == 3


def test_lstm():
    p = L.create(3, 2, 1)
    x, y = rng.normal(size=(4, 5, 2)), np.array([0.0, 1, 1, 0])
    loss, g = L.gradient(x, y, p)
    for name in p:
        at = tuple(0 for _ in p[name].shape)
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += 1e-5
        assert (L.gradient(x, y, q)[0] - loss) / 1e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-6)
    layers = [{"w": p[f"w{k}f"], "u": p[f"u{k}f"], "b": p[f"b{k}f"], "w2": p[f"w{k}b"], "u2": p[f"u{k}b"], "b2": p[f"b{k}b"]} for k in (0, 1)]
    assert np.allclose(L.score(x, p), K.lstm_score(x, layers, (p["w"], p["b"])))
    w = rng.normal(0, 0.3, (400, 9))
    spike = rng.random(400) < 0.5
    w[spike, 4] += 2
    fitted = L.train(w, spike.astype(float), 4, 12)
    assert ((L.score(w, fitted) > 0.5) == spike).mean() > 0.95


def test_clusters():
    points = np.r_[rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2))]
    kind = K.clusters(points, 5)
    assert len(set(kind[:30])) == 1 and len(set(kind[30:])) == 1 and kind[0] != kind[30]
    assert len(set(K.clusters(rng.normal(size=(40, 2)), 5))) <= 2


def test_graph_segments_and_labels():
    image = np.zeros((16, 16))
    image[4:10, 4:10] = 1
    seg = K.graph_segments(image, 0.5, 5)
    assert len(np.unique(seg)) == 2 and len(np.unique(seg[4:10, 4:10])) == 1
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 4] = True
    assert K.label(mask).max() == 2 and K.label(mask)[0, 0] == K.label(mask)[1, 1]


def test_long_splines_by_their_band():
    import time

    rng = np.random.default_rng(0)
    for n, spacing in ((4096, 100), (5003, 25), (4500, 9000)):
        y = np.sin(np.arange(n) / 300) + rng.normal(0, 0.2, n)
        y[700:760] += 5  # a burst that the robust fit leaves out
        dense = G.spline_basis(n, spacing)
        fit = dense @ np.linalg.lstsq(dense, y, rcond=None)[0]
        assert np.abs(G.spline_trend(y, spacing, robust=False) - fit).max() < 1e-9
        keep = np.abs(y - fit) <= np.quantile(np.abs(y - fit), 0.95)
        again = dense @ np.linalg.lstsq(dense[keep], y[keep], rcond=None)[0]
        assert np.abs(G.spline_trend(y, spacing) - again).max() < 1e-4
    y = np.sin(np.arange(100_000) / 300)
    began = time.time()
    assert np.abs(G.spline_trend(y, 100) - y).max() < 1e-3
    assert time.time() - began < 20  # dense: over a gigabyte and minutes


def test_noise_thresholds_and_trends_take_little_memory():
    """Draws of white noise are made some at a time, with the same result; bands are kept in room that grows with the samples."""
    import tracemalloc

    x = np.random.default_rng(0).normal(size=(200, 900))
    x -= x.mean(1, keepdims=True)
    m = np.mean([(x[:, k:] * x[:, : 900 - k]).sum(1) / (x * x).sum(1) for k in range(6)], 0)
    assert np.isclose(G.white_noise_threshold(900, 5, 3.0, 200), m.mean() + 3 * m.std(), rtol=1e-12)
    y = np.cumsum(np.random.default_rng(1).normal(size=20_000)) * 0.1
    for run, megabytes in ((lambda: G.white_noise_threshold(50_000, 5, 3.0, 100), 10), (lambda: [G.trend_filter(y, w, 1) for w in (1.0, 2.0, 3.0, 4.0)], 45)):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < megabytes * 1e6
