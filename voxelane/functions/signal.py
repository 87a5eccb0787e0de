"""NumPy kernels on one trace or a stack of traces (last axis time): spectra, noise, filters, trends."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def welch(y: np.ndarray, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density with periodic Hann segments, half overlap and segment means removed."""
    y = np.atleast_2d(np.asarray(y, float))
    n = min(nperseg, y.shape[-1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = max(1, n - n // 2)
    parts = np.stack([y[:, i : i + n] for i in range(0, y.shape[-1] - n + 1, step)], 1)
    p = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * w)) ** 2 / (w**2).sum()
    p[..., 1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n), p.mean(1)


def summarise(p: np.ndarray, method: str = "logmexp") -> np.ndarray:
    """Noise from densities: root of mean, median or exponentiated mean logarithm of their halves."""
    if method == "mean":
        return np.sqrt((p / 2).mean(-1))
    if method == "median":
        return np.sqrt(np.median(p / 2, -1))
    return np.sqrt(np.exp(np.log((p + 1e-10) / 2).mean(-1)))


def noise_welch(y: np.ndarray, lo: float = 0.25, hi: float = 0.5, method: str = "logmexp") -> np.ndarray:
    """Noise of each trace from frequencies strictly between lo and hi; traces of zeros have none."""
    f, p = welch(y)
    s = summarise(p[:, (f > lo) & (f < hi)], method)
    return np.where(np.atleast_2d(y).any(-1), s, 0.0)


def noise_fft(y: np.ndarray, lo: float = 0.25, hi: float = 0.5, method: str = "logmexp", most: int = 3072) -> np.ndarray:
    """Noise from the plain spectrum in (lo, hi]; long traces give their first, middle and last thirds of `most`."""
    y = np.atleast_2d(np.asarray(y, float))
    if y.shape[-1] > most:
        k, n = most // 3, y.shape[-1]
        y = np.concatenate([y[:, :k], y[:, n // 2 - k // 2 : n // 2 + k - k // 2], y[:, n - k :]], 1)
    f = np.fft.rfftfreq(y.shape[-1])
    p = 2 * np.abs(np.fft.rfft(y)) ** 2 / y.shape[-1]
    return summarise(p[:, (f > lo) & (f <= hi)], method)


def noise_boot(y: np.ndarray, samples: int = 1000, length: int = 25, seed: int = 0, method: str = "mean") -> float:
    """Root of the squared errors of lines fitted to random windows: their mean, median or exponentiated mean logarithm."""
    rng, t = np.random.default_rng(seed), np.arange(length)
    at = rng.integers(0, max(1, len(y) - length + 1), samples)
    w = np.stack([y[a : a + length] for a in at])
    d = t - t.mean()
    slope = (w * d).sum(1) / (d * d).sum()
    error = ((w - w.mean(1, keepdims=True) - slope[:, None] * d) ** 2).mean(1)
    return float(np.sqrt({"mean": np.mean, "median": np.median, "logmexp": lambda x: np.exp(np.log(x + 1e-11).mean())}[method](error)))


def butter(order: int, cut: float, high: bool = False) -> list[np.ndarray]:
    """Second-order sections of a Butterworth filter by the bilinear transform; cut is a share of the Nyquist frequency."""
    k = np.tan(np.pi * cut / 2)
    out = []
    for i in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * i + 1) / (2 * order))
        d = 1 + k * q + k * k
        b = np.array([1.0, -2.0, 1.0]) if high else np.array([1.0, 2.0, 1.0]) * k * k
        out.append(np.r_[b, d, 2 * (k * k - 1), 1 - k * q + k * k] / d)
    if order % 2:
        b = np.array([1.0, -1.0, 0.0]) if high else np.array([k, k, 0.0])
        out.append(np.r_[b, 1 + k, k - 1, 0.0] / (1 + k))
    return out


def butter_band(order: int, lo: float, hi: float) -> list[np.ndarray]:
    """Sections of a Butterworth band-pass, by the band transform of the analog prototype and the bilinear transform; lo and hi are
    shares of the Nyquist frequency. Each section has a pair of poles, and zeros at both ends of the spectrum."""
    w0, w1 = 4 * np.tan(np.pi * lo / 2), 4 * np.tan(np.pi * hi / 2)
    prototype = -np.exp(1j * np.pi * (2 * np.arange(order) - order + 1) / (2 * order)) * (w1 - w0) / 2
    root = np.sqrt(prototype**2 - w0 * w1)
    analog = np.r_[prototype + root, prototype - root]
    gain = (w1 - w0) ** order * (4.0**order / np.prod(4 - analog)).real
    poles = (4 + analog) / (4 - analog)
    left, pairs = list(poles), []
    while left:
        p = left.pop()
        partner = int(np.argmin([abs(q - np.conj(p)) for q in left]))
        pairs.append((p, left.pop(partner)))
    out = [np.array([1.0, 0.0, -1.0, 1.0, -(p + q).real, (p * q).real]) for p, q in pairs]
    out[0][:3] *= gain
    return out


def iir(y: np.ndarray, sections: list[np.ndarray], steady: bool = False) -> np.ndarray:
    """Causal filtering of traces (last axis time) by sections in turn, all traces a sample at a time. steady starts from the state
    that an endless first sample would leave."""
    y = np.moveaxis(np.asarray(y, float), -1, 0)
    for b0, b1, b2, _, a1, a2 in sections:
        out, z1, z2 = np.empty_like(y), np.zeros(y.shape[1:]), np.zeros(y.shape[1:])
        if steady and len(y):
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z2 = (b2 - a2 * gain) * y[0]
            z1 = (b1 - a1 * gain) * y[0] + z2
        for i, x in enumerate(y):
            out[i] = v = b0 * x + z1
            z1, z2 = b1 * x - a1 * v + z2, b2 * x - a2 * v
        y = out
    return np.moveaxis(y, 0, -1)


def lowpass(y: np.ndarray, cut: float, order: int = 5) -> np.ndarray:
    return iir(y, butter(order, cut))


def bandpass(y: np.ndarray, lo: float, hi: float, order: int = 5) -> np.ndarray:
    return iir(y, butter_band(order, lo, hi))


def highpass_zero_phase(y: np.ndarray, cut: float, order: int = 6) -> np.ndarray:
    """Filtered forth and back from steady states, with odd extensions at the ends."""
    y = np.asarray(y, float)
    n = min(3 * (order + 1), y.shape[-1] - 1)
    first, last = y[..., :1], y[..., -1:]
    ext = np.concatenate([2 * first - y[..., n:0:-1], y, 2 * last - y[..., -2 : -n - 2 : -1]], -1) if n > 0 else y
    s = butter(order, cut, high=True)
    out = iir(iir(ext, s, True)[..., ::-1], s, True)[..., ::-1]
    return out[..., n : n + y.shape[-1]]


def savgol(y: np.ndarray, window: int = 201, order: int = 7) -> np.ndarray:
    """Local polynomial smoothing; the ends are read off the first and last full window's polynomial."""
    y = np.asarray(y, float)
    window = min(window, len(y) - (len(y) + 1) % 2)
    h, order = window // 2, min(order, window - 1)
    x = np.arange(-h, h + 1) / max(h, 1)
    a = np.vander(x, order + 1, increasing=True)
    project = a @ np.linalg.pinv(a)
    out = np.convolve(y, project[h][::-1], "same")
    out[: h + 1], out[len(y) - h - 1 :] = (project @ y[:window])[: h + 1], (project @ y[-window:])[h:]
    return out


def fir_kaiser(y: np.ndarray, rate: float, transition: float = 5.0, ripple_db: float = 60.0, cut: float = 10.0) -> np.ndarray:
    """Causal Kaiser-window low-pass."""
    width = transition / (rate / 2)
    n = int(np.ceil((ripple_db - 7.95) / 2.285 / (np.pi * width))) + 1
    beta = 0.1102 * (ripple_db - 8.7) if ripple_db > 50 else 0.5842 * max(ripple_db - 21, 0) ** 0.4 + 0.07886 * max(ripple_db - 21, 0)
    m = np.arange(n) - (n - 1) / 2
    h = np.kaiser(n, beta) * np.sinc(2 * cut / rate * m)
    return np.convolve(np.asarray(y, float), h / h.sum())[: len(y)]


def gaussian_band(y: np.ndarray, length: int, sigma: float) -> np.ndarray:
    """Convolution with a normalised Gaussian less its mean."""
    g = np.exp(-((np.arange(length) - (length - 1) / 2) ** 2) / (2 * sigma**2))
    g /= g.sum()
    return np.convolve(np.asarray(y, float), g - g.mean(), "same")


def lanczos_weights(window: int, cut: float) -> np.ndarray:
    half = (window - 1) // 2 + 1
    k = np.arange(1, half)
    side = np.sin(2 * np.pi * cut * k) / (np.pi * k) * np.sinc(k / half)
    return np.r_[side[::-1], 2 * cut, side]


def stimulus_knots(stim: np.ndarray, degree: int = 3, followup: int = 100, spacing: int = 250) -> np.ndarray:
    """Knots that follow a stimulus: `degree` of them where it goes on or off, one `followup` samples later, and about evenly spaced
    whole ones between."""
    on = np.asarray(stim) > 0
    change = np.flatnonzero(on[1:] != on[:-1]) + 1
    places = np.r_[np.repeat(change, degree), np.minimum(change + followup, len(on) - 1)].astype(float)
    edges = np.unique(np.r_[0.0, places, float(len(on))])
    extra = [np.floor(np.linspace(a, b, int(np.round((b - a) / spacing)) + 2)[1:-1]) for a, b in zip(edges[:-1], edges[1:])]
    return np.sort(np.concatenate([places, *extra]))


def spline_basis(n: int, spacing: int = 250, degree: int = 3, inner: np.ndarray | None = None) -> np.ndarray:
    """B-splines on 0..n-1 with the given inner knots, or about evenly spaced whole ones. A knot that repeats degree + 1 times
    lets the spline jump there."""
    if inner is None:
        inner = np.floor(np.linspace(0, n, int(np.round(n / spacing)) + 2)[1:-1])
    knots = np.r_[np.zeros(degree + 1), inner, np.full(degree + 1, float(n))]
    x = np.arange(n, dtype=float)[:, None]
    b = ((x >= knots[:-1]) & (x < knots[1:])).astype(float)
    for d in range(1, degree + 1):  # all splines of a degree at once
        left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        rise = np.where(left, b[:, :-1] * (x - knots[: -d - 1]) / np.where(left, left, 1), 0)
        b = rise + np.where(right, b[:, 1:] * (knots[d + 1 :] - x) / np.where(right, right, 1), 0)
    return b


#: Samples of a trace from which on its splines are fitted by the band of their normal equations.
LONG = 4096


def _banded_trend(y: np.ndarray, spacing: int, robust: bool, q: float) -> np.ndarray:
    """spline_trend() in time and room in proportion to the samples: a sample has four cubic splines, so the normal equations are banded.
    Where the robust fit leaves fewer than four samples between two knots, a ridge of 1e-10 stands for the least norm."""
    n = len(y)
    inner = np.floor(np.linspace(0, n, int(np.round(n / spacing)) + 2)[1:-1])
    knots = np.r_[np.zeros(4), inner, np.full(4, float(n))]
    x = np.arange(n, dtype=float)
    at = np.searchsorted(knots, x, "right") - 1
    b = [np.ones(n)]  # the splines at - d to at of degree d
    for d in range(1, 4):
        share = [(x - knots[at - d + 1 + i]) / (knots[at + 1 + i] - knots[at - d + 1 + i]) for i in range(d)]
        b = [(b[i - 1] * share[i - 1] if i else 0) + (b[i] * (1 - share[i]) if i < d else 0) for i in range(d + 1)]
    b, first, m = np.stack(b), at - 3, len(knots) - 4

    def fit(keep: np.ndarray) -> np.ndarray:
        c, own = b[:, keep], first[keep]
        summed = lambda i, w: np.bincount(own + i, w, m)
        bands = [sum(summed(i, c[i] * c[i + k]) for i in range(4 - k)) for k in range(4)]
        if np.bincount(own, minlength=m - 3).min() < 4:
            bands[0] = bands[0] + 1e-10 * bands[0].max()
        w = Banded(bands).solve(sum(summed(i, c[i] * y[keep]) for i in range(4)))
        return sum(b[i] * w[first + i] for i in range(4))

    out = fit(np.ones(n, bool))
    if robust:
        away = np.abs(y - out)
        out = fit(away <= np.quantile(away, 1 - q))
    return out


def spline_trend(y: np.ndarray, spacing: int = 250, robust: bool = True, q: float = 0.05, inner: np.ndarray | None = None) -> np.ndarray:
    """Least-squares cubic spline; refitted without the largest share q of absolute residuals."""
    y = np.asarray(y, float)
    if inner is None and len(y) >= LONG and spacing >= 8:
        return _banded_trend(y, spacing, robust, q)
    a = spline_basis(len(y), spacing, inner=inner)
    fit = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    if robust:
        away = np.abs(y - fit)
        keep = away <= np.quantile(away, 1 - q)
        fit = a @ np.linalg.lstsq(a[keep], y[keep], rcond=None)[0]
    return fit


def stimulus_trend(y: np.ndarray, stim: np.ndarray, jumps: np.ndarray | None = None, followup: int = 100, spacing: int = 250, robust: bool = True, q: float = 0.05) -> np.ndarray:
    """The spline trend with knots that follow a stimulus; the trend may jump at the samples `jumps`."""
    inner = stimulus_knots(stim, 3, followup, spacing)
    if jumps is not None and len(jumps):
        inner = np.sort(np.r_[inner, np.repeat(np.asarray(jumps, float), 4)])
    return spline_trend(y, spacing, robust, q, inner)


def without_jumps(y: np.ndarray, trend: np.ndarray, stim: np.ndarray, jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y - trend, trend, stim, places) without each jump's sample and its neighbours; places are those of the jumps and of the
    stimulus's changes in what is left."""
    jumps = np.sort(np.asarray(jumps, int))
    gone = np.unique(np.clip(np.r_[jumps - 1, jumps, jumps + 1], 0, len(stim) - 1))
    keep = np.setdiff1d(np.arange(len(stim)), gone)
    on = stim[keep] > 0
    places = np.r_[jumps - 3 * np.arange(len(jumps)) - 1, np.flatnonzero(on[1:] != on[:-1]) + 1]
    return (y - trend)[..., keep], trend[..., keep], stim[keep], np.unique(places)


def bleach_trend(y: np.ndarray, places: np.ndarray, stim: np.ndarray, quadratic: bool = False) -> np.ndarray:
    """For each stretch between places, a curve fitted to its samples without stimulus: a parabola in the first stretch (with
    `quadratic` in all but the last, whose curve has a logarithm), a line in the others."""
    n = y.shape[-1]
    on = np.asarray(stim) > 0
    change = np.flatnonzero(on[1:] != on[:-1]) + 1
    edges = np.r_[0, np.setdiff1d(np.asarray(places, int), change), n]
    out = np.zeros(y.shape)
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        t, last = np.arange(b - a, dtype=float), k == len(edges) - 2
        x = [np.ones(b - a), t]
        if k == 0 or (quadratic and not last):
            x.append(t**2)
        elif quadratic:
            x.append(np.log(t + 100))
        x, off = np.stack(x, 1), ~on[a:b]
        out[..., a:b] = (x @ np.linalg.lstsq(x[off], np.moveaxis(y[..., a:b][..., off], -1, 0), rcond=None)[0]).T if y.ndim > 1 else x @ np.linalg.lstsq(x[off], y[a:b][off], rcond=None)[0]
    return out


def retrend(trend: np.ndarray, places: np.ndarray, stim: np.ndarray, quadratic: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(what a stimulus adds to a trend: the trend less its bleaching, which samples to keep: none within three of a place)."""
    on = np.asarray(stim) > 0
    change = np.flatnonzero(on[1:] != on[:-1]) + 1
    keep = np.ones(trend.shape[-1], bool)
    for p in np.setdiff1d(np.asarray(places, int), change):
        keep[max(0, p - 3) : p + 4] = False
    return trend - bleach_trend(trend, places, stim, quadratic), keep


class Banded:
    """A symmetric positive definite matrix of narrow band, factored by blocks; solving takes time and room in proportion to its size.

    Neighbouring blocks touch by a corner of the band's width alone. So each block is solved for itself, all at once, and only what
    reaches over the corners, so many numbers a block, goes from one to the next. The end is filled up with ones.
    """

    def __init__(self, diagonals: list[np.ndarray], block: int = 64):
        n, w = len(diagonals[0]), len(diagonals) - 1
        self.n, self.size, self.width = n, max(block, w), w
        count = -(-n // self.size)
        full = [np.r_[x[: n - k], np.full(count * self.size - len(x[: n - k]), float(k == 0))] for k, x in enumerate(diagonals)]
        self.inverse = np.zeros((count, self.size, self.size))
        corner = np.zeros((max(0, count - 1), w, w))  # first rows of a block, last columns of the one before
        i = np.arange(self.size)
        for b in range(count):
            a = b * self.size
            d = np.zeros((self.size, self.size))
            for k, x in enumerate(full):
                at = i[: self.size - k]
                d[at, at + k] = d[at + k, at] = x[a : a + self.size - k]
            if b:
                e = corner[b - 1]
                for k in range(1, w + 1):
                    for row in range(k):  # column a + row - k
                        e[row, w + row - k] = full[k][a + row - k]
                d[:w, :w] -= e @ self.inverse[b - 1, self.size - w :, self.size - w :] @ e.T
            self.inverse[b] = np.linalg.inv(d)
        # first rows of a block by all columns of the one before, and all rows of a block by the first of the one after
        self.step = np.matmul(corner, self.inverse[:-1, self.size - w :, :])
        self.back = np.matmul(self.inverse[:-1, :, self.size - w :], corner.transpose(0, 2, 1))

    def solve(self, y: np.ndarray) -> np.ndarray:
        w, m = self.width, len(self.inverse)
        parts = np.zeros((m, self.size))
        parts.reshape(-1)[: self.n] = y
        if m == 1 or not w:
            return np.matmul(self.inverse, parts[:, :, None]).reshape(-1)[: self.n]
        seen = np.matmul(self.step, parts[:-1, :, None])[:, :, 0]
        parts[1:, :w] -= _chained(seen, self.step[1:, :, :w])
        out = np.matmul(self.inverse, parts[:, :, None])[:, :, 0]
        first = _chained(out[::-1, :w], self.back[::-1, :w])[::-1]
        out[:-1] -= np.matmul(self.back, first[1:, :, None])[:, :, 0]
        return out.reshape(-1)[: self.n]


def _chained(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rows z[0] = x[0], z[k + 1] = x[k + 1] - a[k] z[k]."""
    if x.shape[1] == 2:  # plain numbers are faster than arrays of two
        p, q = x[0].tolist()
        out = [(p, q)]
        for (s, t), ((e, f), (g, h)) in zip(x[1:].tolist(), a.tolist()):
            p, q = s - e * p - f * q, t - g * p - h * q
            out.append((p, q))
        return np.array(out)
    out = x.copy()
    for k in range(1, len(out)):
        out[k] -= a[k - 1] @ out[k - 1]
    return out


@lru_cache(maxsize=1)
def _curved(n: int, rho: float) -> Banded:
    """2 + rho D'D for second differences D."""
    main, one, two = np.full(n, 2.0), np.zeros(n), np.zeros(n)
    i = np.arange(n - 2)
    for shift, w in ((0, 1.0), (1, 4.0), (2, 1.0)):
        main[i + shift] += rho * w
    one[i] -= 2 * rho
    one[i + 1] -= 2 * rho
    two[i] += rho
    return Banded([main, one, two])


def trend_filter(y: np.ndarray, weight: float, rounds: int = 400) -> np.ndarray:
    """Minimise |y - w|^2 + weight |second differences of w|_1 by alternating directions, in a band of five diagonals."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 3 or weight <= 0:
        return y.copy()
    rho = float(weight) / max(1e-9, float(np.median(np.abs(np.diff(y, 2)))) + 1e-9)
    solve = _curved(n, rho).solve
    z = u = np.zeros(n - 2)
    w, d, twice = y, np.zeros(n + 2), 2 * y
    for _ in range(rounds):
        d[2:-2] = z - u
        w = solve(twice + rho * d[2:] - 2 * rho * d[1:-1] + rho * d[:-2])
        x = w[:-2] - 2 * w[1:-1] + w[2:] + u
        z = np.sign(x) * np.maximum(np.abs(x) - weight / rho, 0)
        u = x - z
    return w


def _bands(n: np.ndarray, rho: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2 + rho D'D for second differences D of columns of n samples, as unit lower bands and pivots: L (1, 2 below), d. Samples past a
    column's end hang together with nothing."""
    i = np.arange(most)[:, None]
    term = lambda k: rho * ((i - k >= 0) & (i - k < n - 2))  # noqa: E731  rows of D that hold a sample as their k-th
    a, b, c = term(0), term(1), term(2)
    main, one, two = 2.0 + a + 4 * b + c, -2 * (a + b), a
    d, low, far = np.empty_like(main), np.zeros_like(main), np.zeros_like(main)
    for k in range(most):
        d[k] = main[k]
        below = one[k].copy()
        if k > 0:
            d[k] -= low[k - 1] ** 2 * d[k - 1]
            below -= low[k - 1] * d[k - 1] * far[k - 1]
        if k > 1:
            d[k] -= far[k - 2] ** 2 * d[k - 2]
        low[k], far[k] = below / d[k], two[k] / d[k]
    return low, far, d


def _solve(low: np.ndarray, far: np.ndarray, d: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Solve for each column, in place of the right sides."""
    n = len(x)
    for k in range(1, n):
        x[k] -= low[k - 1] * x[k - 1]
        if k > 1:
            x[k] -= far[k - 2] * x[k - 2]
    x /= d
    for k in range(n - 2, -1, -1):
        x[k] -= low[k] * x[k + 1]
        if k < n - 2:
            x[k] -= far[k] * x[k + 2]
    return x


#: Columns below which blocks of one column's samples are faster than one sample of all columns.
FEW = 32


def columns(traces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time x traces with 0 past each end, lengths)."""
    n = np.array([len(y) for y in traces])
    out = np.zeros((max(n.max(initial=0), 3), len(traces)))
    for k, y in enumerate(traces):
        out[: len(y), k] = y
    return out, n


def trend_filters(y: np.ndarray, n: np.ndarray, weight: np.ndarray, rounds: int = 400) -> np.ndarray:
    """trend_filter() of each column's first n samples; few columns one by one, many side by side, a sample of all at a time."""
    if len(n) < FEW:
        out = y.copy()
        for k in range(len(n)):
            out[: n[k], k] = trend_filter(y[: n[k], k], weight[k], rounds)
        return out
    live = (n >= 3) & (weight > 0)
    if not live.all():
        out = y.copy()
        if live.any():
            out[:, live] = trend_filters(y[:, live], n[live], weight[live], rounds)
        return out
    inside = np.arange(len(y) - 2)[:, None] < n - 2
    bend = np.abs(np.where(inside, np.diff(y, 2, axis=0), np.nan))
    rho = weight / np.maximum(1e-9, np.nanmedian(bend, axis=0) + 1e-9)
    bands, cut = _bands(n, rho, len(y)), weight / rho
    z, u = np.zeros(inside.shape), np.zeros(inside.shape)
    for _ in range(rounds):
        z -= u
        z *= rho
        w = 2 * y
        w[:-2] += z
        w[2:] += z
        z *= 2
        w[1:-1] -= z
        _solve(*bands, w)
        u += w[:-2]
        u -= 2 * w[1:-1]
        u += w[2:]
        u *= inside
        z = np.sign(u) * np.maximum(np.abs(u) - cut, 0)
        u -= z
    return w


def constrained_trends(y: np.ndarray, n: np.ndarray, sigma: np.ndarray, rounds: int = 20, steps: int = 100) -> np.ndarray:
    """constrained_trend() of each column's first n samples."""
    lo, hi, best = 1e-3 * np.maximum(sigma, 1e-9), 1e6 * np.maximum(sigma, 1e-9), y.copy()
    live = sigma > 1e-3
    for _ in range(rounds if live.any() else 0):
        mid = np.sqrt(lo * hi)
        w = trend_filters(y, n, mid, steps)
        inside = np.arange(len(y))[:, None] < n
        within = np.sqrt((((y - w) * inside) ** 2).sum(0) / np.maximum(n, 1)) <= sigma
        lo, hi = np.where(within, mid, lo), np.where(within, hi, mid)
        take = within & live
        best[:, take] = w[:, take]
    return best


def constrained_trend(y: np.ndarray, sigma: float, rounds: int = 20, steps: int = 100) -> np.ndarray:
    """The smoothest trend filter whose residual stays within sigma a sample, by bisection of the logarithm of the weight."""
    y = np.asarray(y, float)
    return constrained_trends(columns([y])[0], np.array([len(y)]), np.array([float(sigma)]), rounds, steps)[: len(y), 0]


def detect_regions(y: np.ndarray, sigma: float | None = None, cut: float = 0.02, order: int = 6, consecutive: int = 2, least: float = 5.0, gap: int = 400, buffer: int = 50, discount: float = 0.0) -> tuple[list[np.ndarray], np.ndarray]:
    """(regions, factors): the samples cut into stretches around spikes and between them. Spikes are runs of `consecutive` samples whose
    high-passed value exceeds `least` deviations of the noise; those less than `gap` apart share a region, widened by `buffer`. The
    factor of a spiking region is 1 - discount, of others 1."""
    y = np.asarray(y, float)
    sigma = noise_welch(y)[0] if sigma is None else sigma
    if sigma <= 0:
        return [np.arange(len(y))], np.ones(1)
    over = np.abs(highpass_zero_phase(y, cut, order) / sigma) > least
    edge = np.flatnonzero(np.diff(np.r_[0, over, 0]))
    runs = [(a, b) for a, b in zip(edge[::2], edge[1::2]) if b - a >= consecutive]
    joined: list[list[int]] = []
    for a, b in runs:
        if joined and a - joined[-1][1] < gap:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    cuts, active, at = [], [], 0
    for a, b in joined:
        a, b = max(at, a - buffer), min(len(y), b + buffer)
        if a > at:
            cuts.append(np.arange(at, a))
            active.append(0)
        if cuts and active[-1] and a == at:
            cuts[-1] = np.r_[cuts[-1], np.arange(a, b)]
        else:
            cuts.append(np.arange(a, b))
            active.append(1)
        at = b
    if at < len(y):
        cuts.append(np.arange(at, len(y)))
        active.append(0)
    return cuts, 1 - discount * np.array(active, float)


def constrained_trend_in_regions(y: np.ndarray, sigma: float | None = None, rounds: int = 20, **where: float) -> np.ndarray:
    """constrained_trend() of each region for itself, its noise shrunk by the region's factor."""
    y = np.asarray(y, float)
    sigma = noise_welch(y)[0] if sigma is None else sigma
    out = y.copy()
    for region, factor in zip(*detect_regions(y, sigma, **where)):
        out[region] = constrained_trend(y[region], sigma * factor, rounds)
    return out


def estimate_noise(y: np.ndarray, estimator: str = "welch", method: str = "logmexp", lo: float = 0.25, hi: float = 0.5, most: int = 3072, samples: int = 1000, length: int = 25) -> np.ndarray:
    """The noise of each trace by one of three estimators: welch, fft or boot."""
    y = np.atleast_2d(np.asarray(y, float))
    if estimator == "welch":
        return noise_welch(y, lo, hi, method)
    if estimator == "fft":
        return noise_fft(y, lo, hi, method, most)
    if estimator == "boot":
        return np.array([noise_boot(x, samples, length, method=method) for x in y])
    raise ValueError("estimator is welch, fft or boot")


def acf_mean(v: np.ndarray, maxlag: int) -> float:
    """Mean autocorrelation over lags 0..maxlag of a standardised trace."""
    v = v - v.mean()
    s = (v * v).sum()
    return float(np.mean([(v[k:] * v[: len(v) - k]).sum() / s for k in range(maxlag + 1)])) if s else 1.0


#: Samples of noise that are drawn together, one draw at least.
DRAWN = 1 << 17


@lru_cache(maxsize=64)
def white_noise_threshold(n: int, maxlag: int, z: float, draws: int = 3000, seed: int = 0) -> float:
    """mean + z deviations of acf_mean over white noise; a worker draws it once for each length, some draws at a time."""
    rng, m = np.random.default_rng(seed), np.empty(draws)
    at_once = max(1, DRAWN // max(1, n))
    for a in range(0, draws, at_once):
        x = rng.normal(size=(min(at_once, draws - a), n))
        x -= x.mean(1, keepdims=True)
        s = np.einsum("ij,ij->i", x, x)
        m[a : a + len(x)] = np.mean([np.einsum("ij,ij->i", x[:, k:], x[:, : max(0, n - k)]) / s for k in range(maxlag + 1)], 0)
    return float(m.mean() + z * m.std())


def choose_rank(v: np.ndarray, maxlag: int = 10, z: float = 1.28, factor: float = 1.0, threshold: float | None = None, by_acf: bool = True, by_kurtosis: bool = False, both: bool = False, ordered: bool = False, min_rank: int = 0) -> np.ndarray:
    """Numbers of the rows of v to keep: more autocorrelated than white noise, or of excess kurtosis beyond the mean and deviation
    of all rows, or both. `ordered` stops at the first row that fails the first test; min_rank rows are kept in any case."""
    keep = np.zeros(len(v), bool)
    if by_acf or both:
        th = (white_noise_threshold(v.shape[1], maxlag, z) if threshold is None else threshold) * factor
        acf = np.array([acf_mean(x, maxlag) >= th for x in v], bool)
        keep = np.logical_and.accumulate(acf) if ordered else acf
    if by_kurtosis or both:
        d = v - v.mean(1, keepdims=True)
        k = (d**4).mean(1) / np.maximum((d**2).mean(1) ** 2, 1e-300) - 3
        tall = k > k.mean() + k.std()
        keep = keep & tall if both else keep | tall
    keep[: min(min_rank, len(v))] |= keep.sum() < min_rank
    return np.flatnonzero(keep)
