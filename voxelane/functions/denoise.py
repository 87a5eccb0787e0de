"""Low-rank denoising of a tile with smooth traces: penalised footprints, greedy components, alternating updates."""

from __future__ import annotations

import numpy as np

from . import signal as G
from .factor import svd


def lasso(y: np.ndarray, v: np.ndarray, weight: float, rounds: int = 500, tol: float = 1e-9) -> np.ndarray:
    """u of least |y - u v|^2 + weight |u|_1 for the rows of v, by coordinate descent."""
    g, p, u = v @ v.T, v @ y, np.zeros(len(v))
    for _ in range(rounds):
        before = u.copy()
        for k in range(len(u)):
            if g[k, k] > 0:
                x = p[k] - g[k] @ u + g[k, k] * u[k]
                u[k] = np.sign(x) * max(0.0, abs(x) - weight / 2) / g[k, k]
        if np.abs(u - before).max(initial=0) <= tol * max(1.0, np.abs(u).max(initial=0)):
            break
    return u


def sparse_footprint(y: np.ndarray, v: np.ndarray, factor: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """(u, weight): the u of least |u|_1 whose residual stays within `factor` a sample, with the weight that gives it. If no u
    reaches that, the regression, with weight 0."""
    most = np.sqrt(y.shape[-1]) * factor
    plain = y @ np.linalg.pinv(v)
    if np.linalg.norm(y - plain @ v) >= most:
        return plain, 0.0
    if np.linalg.norm(y) <= most:
        return np.zeros(len(v)), 2 * float(np.abs(v @ y).max(initial=0))
    lo, hi = 0.0, 2 * float(np.abs(v @ y).max())
    best = plain
    for _ in range(rounds):
        mid = (lo + hi) / 2
        u = lasso(y, v, mid)
        if np.linalg.norm(y - u @ v) <= most:
            lo, best = mid, u
        else:
            hi = mid
    return best, lo


def footprints(m: np.ndarray, v: np.ndarray, factor: float = 1.0, sparse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(u, weights) of all pixels: the regression on the traces, or sparse footprints."""
    if not sparse:
        return m @ np.linalg.pinv(v), np.zeros(len(m))
    each = [sparse_footprint(y, v, factor) for y in m]
    return np.stack([u for u, _ in each]), np.array([w for _, w in each])


def smooth_traces(v: np.ndarray, factor: float = 1.0, regions: bool = False, rounds: int = 12, **where: float) -> np.ndarray:
    """Each trace as the smoothest one within its noise, as a whole or in the regions around its spikes."""
    if regions:
        return np.stack([G.constrained_trend_in_regions(x, None, rounds, **where) for x in v])
    return np.stack([G.constrained_trend(x, s * factor, rounds) for x, s in zip(v, G.noise_welch(v))])


def update_traces(m: np.ndarray, u: np.ndarray, v: np.ndarray, weights: np.ndarray | float | None = None, factor: float = 1.0, regions: bool = False, rounds: int = 12) -> np.ndarray:
    """One turn over the traces: each is what its footprint sees of the movie without the others, smoothed by its weight, or
    within its noise where there is none."""
    v, norm = v.copy(), (u * u).sum(0)
    for k in range(len(v)):
        others = np.arange(len(v)) != k
        x = u[:, k] @ (m - u[:, others] @ v[others]) / max(norm[k], 1e-12)
        if weights is None:
            v[k] = smooth_traces(x[None], factor, regions, rounds)[0]
        else:
            v[k] = G.trend_filter(x, float(np.broadcast_to(weights, len(v))[k]) / max(norm[k], 1e-12))
    return v


def cost(m: np.ndarray, u: np.ndarray, v: np.ndarray, trace_weights: np.ndarray | float = 0.0, pixel_weights: np.ndarray | float = 0.0) -> tuple[float, float, float]:
    """(squared error, weighted second differences of the traces, weighted absolute footprints)."""
    bend = np.abs(np.diff(v, 2, axis=1)).sum(1)
    return float(((m - u @ v) ** 2).sum()), float((trace_weights * bend).sum()), float((pixel_weights * np.abs(u).sum(1)).sum())


def greedy(m: np.ndarray, maxlag: int = 5, z: float = 3.09, factor: float = 1.15, fudge: float = 1.0, sparse: bool = False, regions: bool = False, most: int | None = None, turns: int = 5, tol: float = 5e-3) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of centred rows: components are taken one after another from what the others leave, as long as the residual's first
    trace is more autocorrelated than white noise, `most` at the end if that is given; after each, traces and footprints are updated by
    turns until neither moves."""
    u, v = np.zeros((len(m), 0)), np.zeros((0, m.shape[1]))
    th = G.white_noise_threshold(m.shape[1], maxlag, z) * factor
    while len(v) < min(m.shape if most is None else (most, *m.shape)):
        left = m - u @ v
        a, s, b = svd(left, 1)
        if not s[0] or G.acf_mean(b[0], maxlag) < th:
            break
        new = smooth_traces(b[:1] * s[0], fudge, regions)
        if not new.any():
            break
        v = np.vstack([v, new / np.linalg.norm(new)])
        u = footprints(m, v, fudge, sparse)[0]
        for _ in range(turns if len(v) > 1 else 0):
            before = u @ v
            v = update_traces(m, u, v, None, fudge, regions)
            norm = np.linalg.norm(v, axis=1)
            v = v[norm > 0] / norm[norm > 0, None]
            u = footprints(m, v, fudge, sparse)[0]
            if np.linalg.norm(u @ v - before) <= tol * max(1e-12, np.linalg.norm(before)):
                break
    return u, v


def denoise_patch(m: np.ndarray, maxlag: int = 5, z: float = 3.09, factor: float = 1.15, min_rank: int = 1, greedy_: bool = False, sparse: bool = False, regions: bool = False, by_kurtosis: bool = False, every: int = 1, scale: bool = False) -> tuple[np.ndarray, int]:
    """(movie, rank) of a tile of pixels x time: its means, and the components that pass the tests on samples thinned by `every`,
    their traces over all samples; greedy_ takes smoothed components one by one. scale divides pixels by their noise meanwhile."""
    mean = m.mean(1, keepdims=True)
    d = m - mean
    noise = np.maximum(G.noise_welch(d), 1e-12)[:, None] if scale else np.ones((len(m), 1))
    d = d / noise
    if not d.any():
        return m.copy(), 0
    if greedy_:
        u, v = greedy(d, maxlag, z, factor, 1.0, sparse, regions)
        return u @ v * noise + mean, len(v)
    thin = d[:, ::every]
    u, s, v = svd(thin, max(1, min(thin.shape) // 2))
    keep = G.choose_rank(v, maxlag, z, factor, by_kurtosis=by_kurtosis, min_rank=min_rank)
    u = u[:, keep]
    return u @ (u.T @ d) * noise + mean, len(keep)
