import numpy as np

from voxelane.functions import factor as K
from voxelane.functions import signal as G


def test_noise_of_white_noise():
    y = np.random.default_rng(0).normal(0, 2.0, (20, 3000))
    assert np.allclose(G.noise_welch(y, method="mean").mean(), 2, rtol=0.1)
    assert G.noise_welch(np.zeros((1, 100)))[0] == 0


def test_trends_keep_lines():
    y = 3 + 0.5 * np.arange(100.0)
    assert np.allclose(G.spline_trend(y, 25), y, atol=1e-6)
    assert np.allclose(G.savgol(y, 11, 3), y)
    assert np.allclose(G.trend_filter(y, 10), y, atol=1e-4)


def test_translation_is_recovered():
    a = np.random.default_rng(1).normal(size=(32, 32))
    assert np.allclose(K.translation(np.roll(a, (3, -2), (0, 1)), a), (3, -2), atol=0.5)


def test_low_rank_denoising_lowers_the_error():
    rng = np.random.default_rng(2)
    clean = np.outer(rng.random(30), np.sin(np.arange(200) / 8)) * 3
    noisy = clean + rng.normal(0, 1, clean.shape)
    got, rank = K.denoise_tile(noisy)
    assert rank >= 1 and ((got - clean) ** 2).mean() < ((noisy - clean) ** 2).mean()


def test_demix_of_an_empty_block():
    a, c = K.demix_block(np.zeros((4, 4, 10)))
    assert a.shape == (16, 1) and not a.any() and not c.any()
