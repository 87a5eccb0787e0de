"""Blocks worked on by chunks of frames against the kernels that hold all frames."""

import numpy as np
import pytest

from voxelane.functions import factor as K
from voxelane.functions import signal as G
from voxelane.operators import chunked as H
from voxelane.operators import tilefactors as U


def movie(spark, a, t):
    x, y, k = (i.ravel() for i in np.indices(a.shape))
    return spark.createDataFrame([(int(t[c]), int(p), int(q), float(v)) for p, q, c, v in zip(x, y, k, a.ravel())], "t long, x long, y long, v double")


def cube(rows, shape, t):
    out = np.full(shape, np.nan)
    for r in rows.collect():
        out[r.x, r.y, t.index(r.t)] = r.v
    return out


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(4)
    t = [int(i) for i in range(3, 903) if i % 7]
    a = rng.normal(size=(5, 4, len(t))) + 2 + np.cumsum(rng.normal(size=len(t))) * rng.random((5, 4, 1)) * 0.2
    a[2, 1] = 0
    return a, t


def test_weights_of_blocks_by_chunks(spark, waves):
    a, t = waves
    rows = movie(spark, a, t)
    noise = lambda b: G.noise_welch(b.reshape(-1, b.shape[2])).reshape(b.shape[:2])

    def kernel(n, shape, mean, c, p):
        f = np.fft.rfftfreq(min(H.SEGMENT, n))
        return K.wiener_weights(c / (n - 1), mean, np.nan_to_num(G.summarise(p[:, (f > 0.25) & (f < 0.5)])).reshape(shape), 1)

    got = cube(H.by_moments(rows, 8, kernel, spectra=True, frames=256), a.shape, t)
    assert np.allclose(got, K.wiener(a, noise(a), 1), atol=1e-8)
    got = cube(H.by_moments(rows, 4, lambda n, shape, mean, c, p: K.pca_weights(c, mean, n), frames=128), a.shape, t)
    want = np.concatenate([K.block_pca(b.reshape(-1, len(t))).reshape(b.shape) for b in (a[:4], a[4:])])
    assert np.allclose(got, want, atol=1e-8)


def test_short_movies_and_none(spark):
    a = np.random.default_rng(5).normal(size=(3, 3, 90))
    f = lambda n, shape, mean, c, p: (np.eye(9), np.full(9, float(p.shape[1])))
    assert np.allclose(cube(H.by_moments(movie(spark, a, range(90)), 4, f, spectra=True), a.shape, list(range(90))), a + 46)
    assert not H.by_moments(movie(spark, a, range(90)).where("t < 0"), 4, f).collect()


def test_tiles_by_chunks_are_those_of_whole_tiles(spark):
    rng = np.random.default_rng(6)
    t = [int(i) for i in range(600) if i % 5 != 2]
    wave = np.sin(np.arange(len(t)) / 9)
    a = rng.normal(size=(8, 8, len(t))) + 3 * wave * rng.random((8, 8, 1)) + 1
    rows = movie(spark, a, t)
    want, weight = np.zeros(a.shape), np.zeros(a.shape[:2])
    for grid in U.GRIDS:
        g = U.Grid(8, 8, 2)
        ex, ey = g.edges(grid)
        for k in range((len(ex) - 1) * (len(ey) - 1)):
            x0, y0, w, h = g.box(grid, k)
            part = a[x0 : x0 + w, y0 : y0 + h]
            want[x0 : x0 + w, y0 : y0 + h] += K.denoise_tile(part.reshape(-1, len(t)))[0].reshape(part.shape) * g.weight(grid, k)[:, :, None]
            weight[x0 : x0 + w, y0 : y0 + h] += g.weight(grid, k)
    numbered, back, n = H.in_order(rows)
    assert n == len(t) and np.allclose(weight, 1)
    found = U.factor_tiles(numbered, 8, 8, 2, 100, chance=G.white_noise_threshold)
    assert np.allclose(cube(back(U.voxels(found, numbered.select("t").distinct(), 100)), a.shape, t), want, atol=1e-8)
    ranks = U.greedy_tiles(rows, 8, 8, 2, 100, factor=0.0, most=1).ranks().collect()
    assert len(ranks) == 9 and {r["rank"] for r in ranks} == {1}


def test_block_tables_see_whole_blocks_in_order(spark):
    """Chunks of frames, negative times included, come back as the cube that all rows make."""
    import pandas as pd

    from voxelane.operators import grouped as D

    a, t = np.random.default_rng(7).normal(size=(5, 3, 40)), [int(i) for i in np.arange(-20, 20) * 900]
    a[1, 1, 5] = 0
    rows = movie(spark, a, t).where("NOT (x = 1 AND y = 1 AND t = -13500)")
    out = D.block_tables(rows, 4, "x0 long, y0 long, v array<double>", lambda c, x0, y0: pd.DataFrame({"x0": [x0], "y0": [y0], "v": [c.ravel()]})).collect()
    assert {(r.x0, r.y0) for r in out} == {(0, 0), (4, 0)}
    assert all(np.array_equal(np.reshape(r.v, (-1, 3, 40)), a[r.x0 : r.x0 + 4]) for r in out)


def test_component_correlation_by_chunks(spark):
    from voxelane.operators import space as S

    rng = np.random.default_rng(8)
    a, c = rng.normal(size=(3, 2, 50)) + 5, rng.normal(size=(4, 50))
    c[2] = 0.1
    c[3] += a[2, 1]
    rows = movie(spark, a, range(50)).where("NOT (x = 0 AND y = 1 AND t > 30)")
    traces = spark.createDataFrame([(k, t, float(c[k, t])) for k in range(4) for t in range(50) if t != 7], "cell long, t long, c double")
    got = {(r.x, r.y, r.cell): r.r for r in S.component_correlation(rows, traces, 2, 2, 8).collect()}
    assert len(got) == 24
    for (x, y, k), r in got.items():
        own = [t for t in range(31 if (x, y) == (0, 1) else 50) if t != 7]
        want = 0 if k == 2 else np.corrcoef(a[x, y, own], c[k, own])[0, 1]
        assert np.isclose(r, want, atol=1e-9)
