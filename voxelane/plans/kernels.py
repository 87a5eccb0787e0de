"""Queries over grouped NumPy kernels; tests hold the kernels against planted truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import factor as K
from ..functions import signal as G
from ..operators import chunked as H
from ..operators import grouped as D
from ..operators import motion as M
from ..operators import tilefactors as U
from ..operators import traces as T
from .registry import query


def _trace(name: str, kernel, value: bool = False):
    def f(v):
        return (D.per_trace_value if value else D.per_trace)(v.trace, kernel)

    f.__name__ = name
    query()(f)


_trace("noise_welch", lambda y: G.noise_welch(y), True)
_trace("noise_spectrum", lambda y: G.noise_fft(y), True)
_trace("noise_boot", lambda y: G.noise_boot(y, 200, 15), True)
_trace("spline_trend", lambda y: G.spline_trend(y, 25))
_trace("butter_lowpass", lambda y: G.lowpass(y, 0.3))
_trace("butter_bandpass", lambda y: G.bandpass(y, 0.1, 0.4))
_trace("butter_highpass", lambda y: G.highpass_zero_phase(y, 0.2))
_trace("savgol", lambda y: G.savgol(y, 11, 3))
_trace("fir_lowpass", lambda y: G.fir_kaiser(y, 100.0, 20.0))
_trace("gaussian_bandpass", lambda y: G.gaussian_band(y, 11, 2.0))
_trace("lanczos_lowpass", lambda y: np.convolve(y, G.lanczos_weights(9, 0.2), "same"))


@query()
def trend_filter(v):
    return D.per_stack(v.trace, ("pix",), lambda y, n: G.trend_filters(y, n, np.full(len(n), 50.0)))


@query()
def constrained_trend(v):
    return D.per_stack(v.trace, ("pix",), lambda y, n: G.constrained_trends(y, n, np.full(len(n), 30.0), 8))


@query()
def pnr(v):
    """Largest centred value over noise; 0 without noise."""
    return D.per_trace_value(v.trace, lambda y: np.divide((y - y.mean()).max(), G.noise_welch(y)[0]) if G.noise_welch(y)[0] else 0.0)


@query()
def rank_test(v):
    """Mean autocorrelation of each trace, and whether it exceeds white noise."""
    acf = D.per_trace_value(v.trace, lambda y: G.acf_mean(y, 5))
    return acf.select("pix", "v", (F.col("v") > G.white_noise_threshold(64, 5, 1.28, 500)).alias("keep"))


@query()
def block_pca(v):
    """Centred pixels of each block in the span of its first components."""
    return H.by_moments(v.movie, 4, lambda n, shape, mean, c, p: K.pca_weights(c, mean, n))


@query()
def tile_denoise(v):
    """Tiles of four grids denoised, blended by pyramids."""
    movie, back, _ = H.in_order(v.movie)
    found = U.factor_tiles(movie, 8, 8, 2, 256, chance=G.white_noise_threshold)
    return back(U.voxels(found, movie.select("t").distinct(), 256))


@query()
def wiener(v):
    def kernel(n, shape, mean, c, p):
        f = np.fft.rfftfreq(min(H.SEGMENT, n))
        noise = np.nan_to_num(G.summarise(p[:, (f > 0.25) & (f < 0.5)]))
        return K.wiener_weights(c / (n - 1), mean, noise.reshape(shape), 1)

    return H.by_moments(v.movie, 8, kernel, spectra=True)


def _components(a: np.ndarray, x0: int, y0: int, w: np.ndarray) -> pd.DataFrame:
    p, k = np.nonzero(w)
    ny = a.shape[1]
    return pd.DataFrame({"bx": x0, "by": y0, "cell": k.astype(np.int64), "x": p // ny + x0, "y": p % ny + y0, "w": w[p, k]})


CELLS = "bx long, by long, cell long, x long, y long, w double"


@query()
def demix_blocks(v):
    return D.block_tables(v.movie, 4, CELLS, lambda a, x0, y0: _components(a, x0, y0, K.demix_block(a, 1.0, 4, 2)[0]))


@query()
def nmf_rank1(v):
    return D.block_tables(v.movie, 4, CELLS, lambda a, x0, y0: _components(a, x0, y0, K.rank1(a.reshape(-1, a.shape[2]))[0][:, None]))


@query()
def hals(v):
    """Footprints around each block's first pixels, beside a background that all its pixels share."""

    def kernel(a, x0, y0):
        m = a.reshape(-1, a.shape[2])
        start = np.eye(len(m))[:, :3]
        return _components(a, x0, y0, K.hals(a, start, start.T @ m, np.ones((len(m), 1)), m.mean(0)[None])[0])

    return D.block_tables(v.movie, 4, CELLS, kernel)


@query()
def pure_pixels(v):
    def kernel(a, x0, y0):
        found = K.pure_columns(np.maximum(a.reshape(-1, a.shape[2]), 0).T, 0.3, 5)
        return pd.DataFrame({"bx": x0, "by": y0, "rank": np.arange(len(found)), "pixel": found})

    return D.block_tables(v.movie, 4, "bx long, by long, rank long, pixel long", kernel)


@query()
def ls_unmix(v):
    """Traces of each block's components by least squares."""

    def kernel(a, x0, y0):
        m = a.reshape(-1, a.shape[2])
        c = K.unmix(m, np.eye(len(m))[:, :3] + 0.1)
        k, t = np.indices(c.shape)
        return pd.DataFrame({"bx": x0, "by": y0, "cell": k.ravel(), "t": t.ravel(), "c": c.ravel()})

    return D.block_tables(v.movie, 4, "bx long, by long, cell long, t long, c double", kernel)


def _volumes(v):
    return M.volumes(v.volume)


def _registered(name: str, kind: str, planar: bool):
    def f(v):
        vols = M.volumes(v.movie) if planar else _volumes(v)
        return M.transforms(vols, M.middle_reference(vols), kind)

    f.__name__ = name
    query()(f)


for _kind in M.PLANAR:
    _registered(f"register_{_kind.removesuffix('2d')}", _kind, True)
for _kind in M.SPATIAL:
    _registered(f"register_{_kind}", _kind, False)


@query()
def motion_offsets(v):
    """Rotation and shifts of each frame against the middle's mean."""
    vols = M.volumes(v.movie)
    return M.offsets(M.transforms(vols, M.middle_reference(vols)))


@query()
def motion_corrected(v):
    """Volumes moved by the transform of every fourth, held for the three after it."""
    return M.voxels(M.corrected(_volumes(v), every=4)[0])


@query()
def apply_affine(v):
    """Every frame shifted by the transform held for its group."""
    moved = T.transform_hold(v.movie, v.affine, 4)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, t, x0, y0 = D.cube(pdf)
        m = np.array([[1, 0, pdf["dx"].iloc[0]], [0, 1, pdf["dy"].iloc[0]]])
        return D.voxels(K.resample(a[:, :, 0], m)[:, :, None], t, x0, y0)

    return moved.groupBy("t").applyInPandas(run, "t long, x long, y long, v double")


@query()
def ncs(v):
    fx = np.fft.fftfreq(8)
    mask = (np.hypot(fx[:, None], fx[None]) > 0.3).astype(float)

    def kernel(t, a):
        out = K.noise_corrected(np.maximum(a + 1, 0), np.full(a.shape, 0.1), np.ones(a.shape), mask, 0.2)
        return D.voxels(out[:, :, None], np.array([t]), 0, 0)

    return D.per_frame(v.movie, "t long, x long, y long, v double", kernel)


@query()
def spike_cluster(v):
    """(pix, t, kind): clusters of the peaks' (voltage, probability)."""
    peaks = T.spike_peaks(v.prob, 9, 2, 0.3).join(v.trace, ["pix", "t"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        kind = np.zeros(len(pdf), int) if len(pdf) < 10 else K.clusters(pdf[["v", "prob"]].to_numpy(float), 3)
        return pd.DataFrame({"pix": pdf["pix"], "t": pdf["t"], "kind": kind})

    return peaks.groupBy("pix").applyInPandas(run, "pix long, t long, kind long")


@query()
def snr_mask(v):
    """(pix, low): traces whose deviation or signal-to-noise ratio lies in the low tail."""
    noise = D.per_trace_value(v.trace, lambda y: G.noise_welch(y)).withColumnRenamed("v", "noise")
    s = v.trace.groupBy("pix").agg(F.stddev_pop("v").alias("sd")).join(noise, "pix").withColumn("snr", F.log(F.col("sd") ** 2 / F.col("noise") ** 2))
    q = s.agg(F.percentile("sd", 0.2).alias("a"), F.percentile("snr", 0.1).alias("b"))
    return s.join(F.broadcast(q)).select("pix", ((F.col("sd") <= F.col("a")) | (F.col("snr") < F.col("b"))).alias("low"))
