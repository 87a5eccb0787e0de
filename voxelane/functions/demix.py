"""Demixing of a block of pixels into footprints and traces: superpixels, their factorisation, joint least squares with growing
supports, merging, background. Matrices are pixels x time (m), pixels x cells (a) and time x cells (c); pixel x * ny + y."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .factor import label, pure_columns, rank1, svd


def threshold(m: np.ndarray, deviations: float) -> np.ndarray:
    """What of each row exceeds its median by so many median absolute deviations."""
    med = np.median(m, 1, keepdims=True)
    return np.maximum(0, m - med - deviations * np.median(np.abs(m - med), 1, keepdims=True))


def scores(m: np.ndarray) -> np.ndarray:
    d = m - m.mean(1, keepdims=True)
    s = d.std(1, keepdims=True)
    return np.divide(d, s, out=np.zeros_like(d), where=s > 0)


def correlation(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Covariance of every row of m with every standardised column of c: the correlation where rows are scaled to deviation 1."""
    d = c - c.mean(0)
    s = d.std(0)
    return np.nan_to_num(m - m.mean(1, keepdims=True)) @ np.divide(d, s, out=np.zeros_like(d), where=s > 0) / m.shape[1]


def superpixels(m: np.ndarray, shape: tuple[int, int], cut: float, least: int) -> list[np.ndarray]:
    """Sets of pixels joined by neighbours, diagonal ones included, that correlate above the cut; those of more than least pixels."""
    nx, ny = shape
    z = scores(m).reshape(nx, ny, -1)
    parent = np.arange(nx * ny)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    number = np.arange(nx * ny).reshape(nx, ny)
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        here, there = (slice(0, nx - dx), slice(max(0, -dy), ny - max(0, dy))), (slice(dx, nx), slice(max(0, dy), ny + min(0, dy)))
        r = (z[here] * z[there]).mean(-1)
        for i, j in zip(number[here][r > cut].tolist(), number[there][r > cut].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(nx * ny):
        groups.setdefault(root(i), []).append(i)
    return [np.array(g) for g in groups.values() if len(g) > max(1, least)]


def initial(m: np.ndarray, groups: list[np.ndarray], background: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, c, fb, ff): a rank-1 factorisation of each superpixel, and the leading components of the pixels outside all of them."""
    a, c = np.zeros((len(m), len(groups))), np.zeros((m.shape[1], len(groups)))
    for k, g in enumerate(groups):
        a[g, k], c[:, k] = rank1(m[g])
    fb, ff = np.zeros((len(m), background)), np.zeros((m.shape[1], background))
    rest = np.flatnonzero(a.sum(1) == 0)
    if background and len(rest):
        u, s, v = svd(m[rest] - m[rest].mean(1, keepdims=True), background)
        fb[rest, : len(s)], ff[:, : len(s)] = u * s, (v - v.mean(1, keepdims=True)).T
    return a, c, fb, ff


def brightness_order(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argsort(-(a.max(0, initial=0) * c.max(0, initial=0)), kind="stable")


def pure_superpixels(c: np.ndarray, groups: list[np.ndarray], shape: tuple[int, int], patch: tuple[int, int], cut: float) -> np.ndarray:
    """Numbers of the superpixels whose traces the others of their patch don't explain; one that lies in several patches is looked
    at in each."""
    found: set[int] = set()
    where = [set(zip((g // shape[1] // patch[0]).tolist(), (g % shape[1] // patch[1]).tolist())) for g in groups]
    for p in sorted(set().union(*where)):
        inside = np.array([k for k, w in enumerate(where) if p in w])
        found.update(inside[pure_columns(c[:, inside], cut, len(inside))].tolist())
    return np.array(sorted(found), int)


def descend(x: np.ndarray, u: np.ndarray, beta: np.ndarray, mask: np.ndarray | None = None, free: int = 0) -> np.ndarray:
    """One sweep of coordinate descent for u ~ x @ beta with nonnegative beta, where mask is set; the last `free` rows may be negative."""
    g, p, beta = x.T @ x, x.T @ u, beta.astype(float).copy()
    for k in range(len(beta)):
        at = slice(None) if mask is None else mask[k] > 0
        step = beta[k, at] + (p[k, at] - g[k] @ beta[:, at]) / max(g[k, k], 1e-12)
        beta[k, at] = step if k >= len(beta) - free else np.maximum(0, step)
    return beta


def supports(corr: np.ndarray, mask: np.ndarray, shape: tuple[int, int], cut: float, share: float = 0.2, times: int = 10) -> np.ndarray:
    """For each cell the connected region above a correlation cut that overlaps its mask most; the cut falls by 0.1 while there is
    none and rises while the region takes the share of the block or more."""
    out = np.zeros_like(mask)
    for k in range(mask.shape[1]):
        own, at = mask[:, k].reshape(shape) > 0, cut
        region = np.zeros(shape, bool)
        for _ in range(times + 1 if own.any() else 0):
            found = label(corr[:, k].reshape(shape) > at)
            hits = np.bincount(found[own], minlength=found.max() + 1)
            hits[0] = 0
            if not hits.any():
                region = np.zeros(shape, bool)
                if at in (0, 1):
                    break
                at = max(0, at - 0.1)
                continue
            region = found == hits.argmax()
            if region.sum() / region.size < share or at in (0, 1):
                break
            at = min(1, at + 0.1)
        out[:, k] = region.ravel()
    return out


def merged(a: np.ndarray, c: np.ndarray, corr: np.ndarray, m: np.ndarray, cut: float, overlap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(a, c, corr) with cells that overlap, and whose regions above the cut share more than `overlap` of both, replaced by one
    rank-1 factorisation of their sum; None without any. Cells that touch through others merge together."""
    high = (corr > cut).astype(float)
    n, both = high.sum(0), high.T @ high
    with np.errstate(divide="ignore", invalid="ignore"):
        pair = (np.nan_to_num(both / n) > overlap) & (np.nan_to_num(both / n[:, None]) > overlap) & (a.T @ a > 0)
    np.fill_diagonal(pair, False)
    if not pair.any():
        return None
    group = np.arange(len(pair))
    for i, j in zip(*np.nonzero(pair)):
        group[group == group[j]] = group[i]
    sets = [np.flatnonzero(group == g) for g in np.unique(group)]
    alone = np.array([s[0] for s in sets if len(s) == 1], int)
    parts_a, parts_c, parts_r = [a[:, alone]], [c[:, alone]], [corr[:, alone]]
    for s in (s for s in sets if len(s) > 1):
        pixels = a[:, s].sum(1) > 0
        one = np.zeros((len(a), 1))
        one[pixels, 0], trace = rank1(a[np.ix_(pixels, s)] @ c[:, s].T)
        parts_a.append(one)
        parts_c.append(trace[:, None])
        parts_r.append(correlation(m, trace[:, None]))
    return np.hstack(parts_a), np.hstack(parts_c), np.hstack(parts_r)


@dataclass
class Cells:
    """Footprints, traces, constant background, and changing background (pixels x components, time x components)."""

    a: np.ndarray
    c: np.ndarray
    b: np.ndarray
    fb: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    ff: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def model(self) -> np.ndarray:
        out = self.a @ self.c.T + self.b[:, None]
        return out + self.fb @ self.ff.T if self.fb.size else out


def without(cells: Cells, gone: np.ndarray) -> Cells:
    """Cells but for those marked."""
    return Cells(cells.a[:, ~gone], cells.c[:, ~gone], cells.b, cells.fb, cells.ff)


def refine(m: np.ndarray, cells: Cells, shape: tuple[int, int], cut: float, rounds: int = 35, every: int = 4, merge_cut: float = 0.6, overlap: float = 0.6, share: float = 0.3) -> Cells:
    """Footprints and traces by turns, each a sweep of nonnegative coordinate descent, with what is left of each pixel's mean as its
    background. Every so many rounds cells merge and their supports become the regions that correlate with them. At the end
    footprints have norm 1 and cells go by brightness."""
    scaled = m / np.maximum(m.std(1, keepdims=True), 1e-12)
    mean, free = m.mean(1), cells.ff.shape[1] if cells.ff.size else 0
    mask = cells.a > 0
    for k in range(rounds):
        beta = descend(np.hstack([cells.c, cells.ff]) if free else cells.c, (m - cells.b[:, None]).T, np.hstack([cells.a, cells.fb]).T if free else cells.a.T, np.vstack([mask.T, np.ones((free, len(m)), bool)]))
        cells = Cells(beta[: len(beta) - free].T, cells.c, cells.b, beta[len(beta) - free :].T, cells.ff)
        gone = cells.a.sum(0) == 0
        cells, mask = without(cells, gone), mask[:, ~gone]
        cells.b = np.maximum(0, mean - cells.a @ cells.c.mean(0))
        beta = descend(np.hstack([cells.a, cells.fb]) if free else cells.a, m - cells.b[:, None], np.hstack([cells.c, cells.ff]).T if free else cells.c.T, None, free)
        cells.c = beta[: len(beta) - free].T
        if free:
            cells.ff = beta[len(beta) - free :].T
            cells.ff = cells.ff - cells.ff.mean(0)
        gone = cells.c.sum(0) == 0
        cells, mask = without(cells, gone), mask[:, ~gone]
        cells.b = np.maximum(0, mean - cells.a @ cells.c.mean(0))
        if every and (k + 1) % every == 0 and cells.a.shape[1]:
            corr = correlation(scaled, cells.c)
            joined = merged(cells.a, cells.c, corr, scaled, merge_cut, overlap)
            if joined is not None:
                cells.a, cells.c, corr = joined
            mask = supports(corr, cells.a > 0, shape, cut, share)
            gone = mask.sum(0) == 0
            cells, mask = without(cells, gone), mask[:, ~gone]
            cells.a = cells.a * mask
    norm = np.sqrt((cells.a**2).sum(0))
    keep = norm > 0
    cells = Cells(cells.a[:, keep] / norm[keep], cells.c[:, keep] * norm[keep], cells.b, cells.fb, cells.ff)
    order = brightness_order(cells.a, cells.c)
    cells.a, cells.c = cells.a[:, order], cells.c[:, order]
    return cells


def demix(movie: np.ndarray, cuts: list[float], lengths: list[int], deviations: list[float], residual: list[float], cut: float = 0.31, patch: tuple[int, int] = (100, 100), background: int = 0, rounds: int = 35, last_rounds: int = 50, every: int = 4, merge_cut: float = 0.6, overlap: float = 0.6, share: float = 0.3) -> Cells:
    """Cells of a movie (x, y, t) in as many passes as there are cuts, each after the first on what the cells so far leave.

    A pass thresholds its movie, joins superpixels, keeps the pure ones of each patch, and refines all cells on the whole movie.
    A movie without superpixels has no cells. Negative movies are lifted by each pixel's least value.
    """
    nx, ny, n = movie.shape
    m = movie.reshape(nx * ny, n).astype(float)
    if m.min(initial=0) < 0:
        m = m - m.min(1, keepdims=True)
    cells = Cells(np.zeros((len(m), 0)), np.zeros((n, 0)), np.median(m, 1), np.zeros((len(m), background)), np.zeros((n, background)))
    for k, edge in enumerate(cuts):
        now = m - cells.model() if k else m
        bright = threshold(now, deviations[k]) if k or deviations[k] >= 0 else now
        groups = superpixels(bright, (nx, ny), edge, lengths[k])
        if not groups:
            continue
        a, c, fb, ff = initial(bright, groups, 0 if k else background)
        pure = pure_superpixels(c, groups, (nx, ny), patch, residual[k])
        pure = pure[brightness_order(a[:, pure], c[:, pure])]
        if not len(pure):
            continue
        cells.a, cells.c = np.hstack([cells.a, a[:, pure]]), np.hstack([cells.c, c[:, pure]])
        if not k and background:
            cells.fb, cells.ff = fb, ff
        cells = refine(m, cells, (nx, ny), cut, last_rounds if k == len(cuts) - 1 else rounds, every, merge_cut, overlap, share)
    return cells


def recompute(movie: np.ndarray, cells: Cells, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(traces, background, residual) of the cells with more than least pixels: least-squares traces of the movie, lifted to be
    nonnegative, without the background; the background takes the residual's means."""
    m = movie.reshape(-1, movie.shape[2]).astype(float)
    m = m - m.min(1, keepdims=True)
    back = cells.b[:, None] + (cells.fb @ cells.ff.T if cells.fb.size else 0)
    a = cells.a[:, (cells.a > 0).sum(0) > least]
    c = np.linalg.lstsq(a, m - back, rcond=None)[0]
    left = m - a @ c - back
    mean = left.mean(1, keepdims=True)
    return c, back + mean, left - mean


def cell_traces(block: np.ndarray, a: np.ndarray, mask: np.ndarray, cut: float = 0.3, least: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, traces, a inside the mask, their traces) of a block (x, y, t): least-squares traces of all footprints that weigh anything;
    weights under the cut's share of a footprint's largest go, then footprints with more than least pixels inside the mask get
    traces of the masked movie. Without a footprint or a pixel of the mask all are empty."""
    n = block.shape[2]
    m, mask = block.reshape(-1, n).astype(float), np.asarray(mask, bool).ravel()
    a = a[:, a.sum(0) > 0]
    if not a.shape[1] or not mask.any():
        return np.zeros((len(m), 0)), np.zeros((0, n)), np.zeros((len(m), 0)), np.zeros((0, n))
    traces = np.linalg.lstsq(a, m, rcond=None)[0]
    a = np.where(a < cut * a.max(0), 0, a)
    inside = a * mask[:, None]
    inside = inside[:, (inside > 0).sum(0) > least]
    return a, traces, inside, np.linalg.lstsq(inside, m * mask[:, None], rcond=None)[0] if inside.shape[1] else np.zeros((0, n))
