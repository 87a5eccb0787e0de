"""NumPy kernels on matrices and images: low rank, neighbourhood filters, factorisation, segmentation, registration, clusters."""

from __future__ import annotations

import numpy as np

from .signal import acf_mean, white_noise_threshold


def svd(m: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact SVD with the largest entry of each left vector positive."""
    u, s, v = np.linalg.svd(m, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    u, v = u * sign, v * sign[:, None]
    return (u[:, :k], s[:k], v[:k])


def low_rank(m: np.ndarray, k: int) -> np.ndarray:
    u, s, v = svd(m, k)
    return (u * s) @ v


def block_pca(block: np.ndarray, most: int = 300) -> np.ndarray:
    """Centred rows of a pixels-by-time block at rank min(shape) // 4 at most; the means are not restored."""
    c = block - block.mean(1, keepdims=True)
    return low_rank(c, max(1, min(min(c.shape) // 4, most)))


def pca_weights(c: np.ndarray, mean: np.ndarray, n: int, most: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(w, b) with w @ block + b as block_pca() of n frames, from the products of the centred pixels."""
    u = np.linalg.eigh(c)[1][:, ::-1][:, : max(1, min(min(len(c), n) // 4, most))]
    w = u @ u.T
    return w, -w @ mean


def denoise_tile(block: np.ndarray, maxlag: int = 5, z: float = 3.09, factor: float = 1.15, min_rank: int = 1) -> tuple[np.ndarray, int]:
    """Keep the components whose traces are more autocorrelated than white noise; at least min_rank of the first."""
    mean = block.mean(1, keepdims=True)
    u, s, v = svd(block - mean, max(1, min(block.shape) // 2))
    th = white_noise_threshold(block.shape[1], maxlag, z) * factor
    keep = np.array([acf_mean(x, maxlag) >= th for x in v])
    keep[: max(min_rank, 0)] |= not keep.any()
    return (u[:, keep] * s[keep]) @ v[keep] + mean, int(keep.sum())


def wiener(movie: np.ndarray, noise: np.ndarray, half: int = 2) -> np.ndarray:
    """Each pixel (x, y, t) estimated from its neighbourhood: inv(C)(C - D) with noise variances D; singular ones stay."""
    nx, ny, _ = movie.shape
    out = movie.copy()
    for x in range(nx):
        for y in range(ny):
            a, b = slice(max(0, x - half), x + half + 1), slice(max(0, y - half), y + half + 1)
            m = movie[a, b].reshape(-1, movie.shape[2])
            c = np.atleast_2d(np.cov(m))
            own = (x - a.start) * (min(ny, b.stop) - b.start) + y - b.start
            d = np.zeros(len(c))
            d[own] = noise[x, y] ** 2
            try:
                w = np.linalg.solve(c, c[own] - d)
            except np.linalg.LinAlgError:
                continue
            mean = m.mean(1)
            out[x, y] = w @ (m - mean[:, None]) + mean[own]
    return out


def wiener_weights(c: np.ndarray, mean: np.ndarray, noise: np.ndarray, half: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(w, b) with w @ pixels + b as wiener(), from the covariance of all pixels."""
    nx, ny = noise.shape
    w, number = np.eye(len(c)), np.arange(len(c)).reshape(nx, ny)
    b = np.zeros(len(c))
    for x in range(nx):
        for y in range(ny):
            near, k = number[max(0, x - half) : x + half + 1, max(0, y - half) : y + half + 1].ravel(), number[x, y]
            some = c[np.ix_(near, near)]
            d = np.where(near == k, noise[x, y] ** 2, 0.0)
            try:
                row = np.linalg.solve(some, c[k, near] - d)
            except np.linalg.LinAlgError:
                continue
            w[k] = 0
            w[k, near] = row
            b[k] = mean[k] - row @ mean[near]
    return w, b


def nmf(m: np.ndarray, a: np.ndarray, c: np.ndarray, rounds: int = 20, rule: str = "hals", support: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """m ~ a @ c with nonnegative factors, by coordinate sweeps or multiplicative updates; a stays on its support, in each step of a sweep."""
    a, c = a.astype(float).copy(), c.astype(float).copy()
    if support is not None:
        a *= support
    for _ in range(rounds):
        if rule == "mu":
            c *= (a.T @ m) / np.maximum(a.T @ a @ c, 1e-12)
            a *= (m @ c.T) / np.maximum(a @ c @ c.T, 1e-12)
        else:
            g, p = c @ c.T, m @ c.T
            for k in range(a.shape[1]):
                a[:, k] = np.maximum(0, a[:, k] + (p[:, k] - a @ g[:, k]) / max(g[k, k], 1e-12))
                if support is not None:
                    a[:, k] *= support[:, k]
            g, p = a.T @ a, a.T @ m
            for k in range(len(c)):
                c[k] = np.maximum(0, c[k] + (p[k] - g[k] @ c) / max(g[k, k], 1e-12))
    return a, c


def rank1(m: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """One nonnegative component, started from row and column means."""
    m = np.maximum(m, 0)
    a, c = nmf(m, m.mean(1)[:, None], m.mean(0)[None], rounds)
    return a[:, 0], c[0]


def hals(movie: np.ndarray, a: np.ndarray, c: np.ndarray, b: np.ndarray, f: np.ndarray, width: int = 3, rounds: int = 5, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Footprints a, traces c, background footprints b and traces f of a movie (x, y, t) by coordinate sweeps. Footprints stay within
    their starting pixels and those a box of the width reaches from there; footprints are nonnegative, traces free."""
    nx, ny, n = movie.shape
    m, cells = movie.reshape(nx * ny, n).astype(float, copy=False), a.shape[1]
    support, reach = np.zeros((nx, ny, cells), bool), range(-(width // 2), width - width // 2)
    start = a.reshape(nx, ny, cells) > 1e-10
    for dx in reach:
        for dy in reach:
            to = (slice(max(0, dx), nx + min(0, dx)), slice(max(0, dy), ny + min(0, dy)))
            of = (slice(max(0, -dx), nx - max(0, dx)), slice(max(0, -dy), ny - max(0, dy)))
            support[to] |= start[of]
    mask = np.c_[support.reshape(nx * ny, cells), np.ones((nx * ny, b.shape[1]), bool)]
    a, c = np.c_[a, b].astype(float), np.r_[c, f].astype(float)
    for _ in range(rounds):
        u, v = a.T @ m, a.T @ a
        for _ in range(sweeps):
            for k in range(len(c)):
                c[k] += (u[k] - v[k] @ c) / max(v[k, k], 1e-12)
        u, v = c @ m.T, c @ c.T
        for _ in range(sweeps):
            for k in range(len(c)):
                at = mask[:, k]
                a[at, k] = np.maximum(0, a[at, k] + (u[k, at] - v[k] @ a[at].T) / max(v[k, k], 1e-12))
    return a[:, :cells], c[:cells], a[:, cells:], c[cells:]


def pure_columns(m: np.ndarray, th: float, most: int) -> list[int]:
    """Successive projection: the column with the largest residual in proportion to its own norm, near ties by norm, while that
    proportion's root exceeds th. Columns are scaled to sum 1 first; columns of zeros are never taken."""
    total = m.sum(0)
    x = np.divide(m, total, out=np.zeros(m.shape), where=total != 0)
    norm = (x**2).sum(0)
    left, out, basis = norm.copy(), [], []
    while len(out) < most:
        share = np.divide(left, norm, out=np.zeros(len(norm)), where=norm > 0)
        if not len(share) or np.sqrt(share.max()) <= th:
            break
        near = np.flatnonzero(share >= share.max() * (1 - 1e-6))
        k = int(near[norm[near].argmax()])
        u = x[:, k].copy()
        for b in basis:
            u -= b * (b @ u)
        n = np.linalg.norm(u)
        if n < 1e-12:
            break
        out.append(k)
        basis.append(u / n)
        left = np.maximum(left - (basis[-1] @ x) ** 2, 0)
    return out


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected regions numbered from 1."""
    out, k = np.zeros(mask.shape, int), 0
    for s in zip(*np.nonzero(mask)):
        if out[s]:
            continue
        k += 1
        todo = [s]
        out[s] = k
        while todo:
            x, y = todo.pop()
            for p in range(max(0, x - 1), min(mask.shape[0], x + 2)):
                for q in range(max(0, y - 1), min(mask.shape[1], y + 2)):
                    if mask[p, q] and not out[p, q]:
                        out[p, q] = k
                        todo.append((p, q))
    return out


def graph_segments(image: np.ndarray, scale: float, least: int) -> np.ndarray:
    """Graph-based segmentation: edges by weight join regions whose internal difference plus scale / size exceeds it; small
    regions then join across their lightest edge."""
    nx, ny = image.shape
    number = np.arange(nx * ny).reshape(nx, ny)
    e = []
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        a, b = number[: nx - dx, max(0, -dy) : ny - max(0, dy)], number[dx:, max(0, dy) : ny + min(0, dy)]
        e.append(np.stack([a.ravel(), b.ravel()], 1))
    e = np.concatenate(e)
    w = np.abs(image.ravel()[e[:, 0]] - image.ravel()[e[:, 1]])
    order = np.argsort(w, kind="stable")
    parent, size, inner = np.arange(nx * ny), np.ones(nx * ny, int), np.zeros(nx * ny)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for small in (False, True):
        for k in order:
            a, b = root(e[k, 0]), root(e[k, 1])
            join = min(size[a], size[b]) < least if small else w[k] < min(inner[a] + scale / size[a], inner[b] + scale / size[b])
            if a != b and join:
                parent[b] = a
                size[a] += size[b]
                inner[a] = max(w[k], inner[a], inner[b])
    return np.unique([root(i) for i in range(nx * ny)], return_inverse=True)[1].reshape(nx, ny)


def demix_block(movie: np.ndarray, scale: float = 10.0, segment: int = 50, blob: int = 10, cut: float = 0.3, image: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(footprints pixels x cells, traces cells x time) of a block (x, y, t): segments of an image, by default of the largest values, dilated, seed a joint
    factorisation; weak weights are cut, footprints split into blobs, refined and normalised. An empty block has one zero cell."""
    nx, ny, n = movie.shape
    m, top = np.maximum(movie.reshape(-1, n), 0), movie.max(2) if image is None else image
    if top.max() <= 0:
        return np.zeros((nx * ny, 1)), np.zeros((1, n))
    seg, seeds = graph_segments(top / top.max(), scale, segment), []
    for k in range(seg.max() + 1):
        mask = seg == k
        if mask.sum() > blob:
            grown = np.zeros_like(mask)
            for x, y in zip(*np.nonzero(mask)):
                grown[max(0, x - 2) : x + 3, max(0, y - 2) : y + 3] = True
            a, c = rank1(m * grown.ravel()[:, None])
            seeds.append((a, c))
    if not seeds:
        return np.zeros((nx * ny, 1)), np.zeros((1, n))
    a, c = nmf(m, np.stack([s[0] for s in seeds], 1), np.stack([s[1] for s in seeds]), 20)
    a[a < cut * a.max(1, keepdims=True)] = 0
    parts = []
    for k in range(a.shape[1]):
        f = a[:, k].reshape(nx, ny)
        blobs = label(f > cut * f.max()) if f.max() > 0 else np.zeros((nx, ny), int)
        parts += [(np.where(blobs == i, f, 0).ravel(), c[k]) for i in range(1, blobs.max() + 1) if (blobs == i).sum() > blob]
    if not parts:
        return np.zeros((nx * ny, 1)), np.zeros((1, n))
    a, c = nmf(m, np.stack([p[0] for p in parts], 1), np.stack([p[1] for p in parts]) + 1e-9, 10, "mu")
    a[a < cut * a.max(1, keepdims=True)] = 0
    return a / np.maximum(np.linalg.norm(a, axis=0), 1e-12), c


def unmix(m: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Least-squares traces of footprints."""
    return np.linalg.lstsq(a, m, rcond=None)[0]


def translation(moving: np.ndarray, fixed: np.ndarray) -> tuple[float, float]:
    """Shift (dx, dy) that takes fixed to moving, by phase correlation with a parabola through the peak."""
    f = np.fft.fft2(moving - moving.mean()) * np.conj(np.fft.fft2(fixed - fixed.mean()))
    r = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    at = np.unravel_index(r.argmax(), r.shape)
    out = []
    for axis, n in enumerate(r.shape):
        pick = lambda d: r[tuple((at[i] + (d if i == axis else 0)) % r.shape[i] for i in range(2))]
        lo, mid, hi = pick(-1), pick(0), pick(1)
        bend = lo - 2 * mid + hi
        shift = at[axis] + (0.5 * (lo - hi) / bend if bend else 0)
        out.append(float(shift - n if shift > n / 2 else shift))
    return out[0], out[1]


def resample(image: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Bilinear: out(p) = image(matrix @ p), 0 outside. matrix is 2 x 3."""
    x, y = np.meshgrid(np.arange(image.shape[0]), np.arange(image.shape[1]), indexing="ij")
    p = matrix[:, 0, None, None] * x + matrix[:, 1, None, None] * y + matrix[:, 2, None, None]
    i = np.floor(p).astype(int)
    f, out = p - i, np.zeros(image.shape)
    for a in (0, 1):
        for b in (0, 1):
            u, v = i[0] + a, i[1] + b
            ok = (u >= 0) & (u < image.shape[0]) & (v >= 0) & (v < image.shape[1])
            out += np.where(ok, image[np.clip(u, 0, image.shape[0] - 1), np.clip(v, 0, image.shape[1] - 1)], 0) * (f[0] if a else 1 - f[0]) * (f[1] if b else 1 - f[1])
    return out


def mutual_information(a: np.ndarray, b: np.ndarray, bins: int = 32) -> float:
    h = np.histogram2d(a.ravel(), b.ravel(), bins)[0]
    p = h / max(1, h.sum())
    q = p.sum(1)[:, None] * p.sum(0)
    ok = p > 0
    return float((p[ok] * np.log(p[ok] / q[ok])).sum())


def rigid(moving: np.ndarray, fixed: np.ndarray, reach: float = 0.1, rounds: int = 5) -> np.ndarray:
    """The 2 x 3 matrix that brings moving onto fixed: translation first, then angle and shift by coarse-to-fine search for mutual
    information, around the image's centre."""
    dx, dy = translation(moving, fixed)
    mid = (np.array(moving.shape) - 1) / 2

    def matrix(t: float, x: float, y: float) -> np.ndarray:
        r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        return np.c_[r, mid - r @ mid + np.array([x, y])]

    best, step = (0.0, dx, dy), np.array([reach, 1.0, 1.0])
    score = mutual_information(resample(moving, matrix(*best)), fixed)
    for _ in range(rounds):
        for axis in range(3):
            for sign in (-1, 1):
                trial = list(best)
                trial[axis] += sign * step[axis]
                s = mutual_information(resample(moving, matrix(*trial)), fixed)
                if s > score:
                    best, score = tuple(trial), s
        step /= 2
    return matrix(*best)


def noise_cost(u: np.ndarray, data: np.ndarray, extra: np.ndarray, mask: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """The Poisson-Gaussian cost of a square image u and its gradient: likelihood of the data, plus alpha times the energy that the
    mask lets through. extra is the noise variance in photons."""
    z = u + extra + 1e-12
    masked = np.fft.fft2(u) * np.fft.ifftshift(mask) ** 2
    energy = (np.abs(np.fft.fft2(u)) / len(u) * np.fft.ifftshift(mask)) ** 2
    value = (u - (data + extra) * np.log(z)).sum() + alpha * energy.sum()
    return float(value), 1 - (data + extra) / z + 2 * alpha * np.fft.ifft2(masked).real * u.size / len(u) ** 2


def bounded_minimum(f, x: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Least value of f (which gives value and gradient) over nonnegative x: projected steps of the length that the last change of
    the gradient suggests, halved until the value falls."""
    x = np.maximum(x, 0)
    value, g = f(x)
    step = 1.0
    for _ in range(rounds):
        while True:
            y = np.maximum(0, x - step * g)
            low, h = f(y)
            d = y - x
            if low <= value + 1e-4 * (g * d).sum() or step < 1e-12:
                break
            step /= 2
        if not np.isfinite(low) or low > value:
            return x
        change = (d * (h - g)).sum()
        done = abs(value - low) <= tol * max(1.0, abs(value))
        x, value, g = y, low, h
        step = min(1e4, max(1e-6, (d * d).sum() / change)) if change > 0 else min(1e4, 2 * step)
        if done:
            break
    return x


def noise_corrected(u: np.ndarray, var: np.ndarray, gain: np.ndarray, mask: np.ndarray, alpha: float, rounds: int = 200) -> np.ndarray:
    """The image of least noise_cost(); untouched without variance. mask has the zero frequency in the middle."""
    if not var.any():
        return u
    extra = var / (gain + 1e-12) ** 2
    extra = np.where(gain == 1e-6, 1e-6, extra)
    return bounded_minimum(lambda x: noise_cost(x, u, extra, mask, alpha), np.maximum(u, 0).astype(float), rounds)


def bounded_minima(f, x: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """bounded_minimum() of many images (n, width, height) side by side, each in its own steps. f(images, own) gives values and
    gradients of the images numbered `own`."""
    every = lambda a: a[:, None, None]
    total = lambda a: a.reshape(len(a), -1).sum(1)
    x = np.maximum(x, 0)
    live = np.arange(len(x))
    value, g = f(x, live)
    step, y, low, h = np.ones(len(x)), x.copy(), value.copy(), g.copy()
    for _ in range(rounds):
        todo = live
        while len(todo):
            y[todo] = np.maximum(0, x[todo] - every(step[todo]) * g[todo])
            low[todo], h[todo] = f(y[todo], todo)
            slope = total(g[todo] * (y[todo] - x[todo]))
            todo = todo[~((low[todo] <= value[todo] + 1e-4 * slope) | (step[todo] < 1e-12))]
            step[todo] /= 2
        live = live[np.isfinite(low[live]) & ~(low[live] > value[live])]
        if not len(live):
            break
        d = y[live] - x[live]
        change = total(d * (h[live] - g[live]))
        done = np.abs(value[live] - low[live]) <= tol * np.maximum(1.0, np.abs(value[live]))
        rise = change > 0
        x[live], value[live], g[live] = y[live], low[live], h[live]
        step[live] = np.minimum(1e4, np.where(rise, np.maximum(1e-6, total(d * d) / np.where(rise, change, 1)), 2 * step[live]))
        live = live[~done]
    return x


def noise_corrected_many(u: np.ndarray, var: np.ndarray, gain: np.ndarray, mask: np.ndarray, alpha: float, rounds: int = 200) -> np.ndarray:
    """noise_corrected() of each of many square images (n, side, side) with their own maps, side by side."""
    out, some = np.array(u, float), np.flatnonzero(var.any((1, 2)))
    data, var, gain = out[some], var[some], gain[some]
    extra = np.where(gain == 1e-6, 1e-6, var / (gain + 1e-12) ** 2)
    side, shifted = u.shape[-1], np.fft.ifftshift(mask)

    def cost(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, seen, spectrum = x + extra[own] + 1e-12, data[own] + extra[own], np.fft.fft2(x)
        energy = (np.abs(spectrum) / side * shifted) ** 2
        value = (x - seen * np.log(z)).reshape(len(x), -1).sum(1) + alpha * energy.reshape(len(x), -1).sum(1)
        return value, 1 - seen / z + 2 * alpha * np.fft.ifft2(spectrum * shifted**2).real

    if len(some):
        out[some] = bounded_minima(cost, np.maximum(data, 0), rounds)
    return out


def clusters(points: np.ndarray, least: int = 5, eps: float = 0.5, step: float = 0.1) -> np.ndarray:
    """Density clusters of standardised points, the radius grown until one cluster is left, or two without noise; -1 is noise."""
    p = (points - points.mean(0)) / np.maximum(points.std(0), 1e-12)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    while True:
        near = d <= eps
        core, out, k = near.sum(1) >= least, np.full(len(p), -1), 0
        for s in np.flatnonzero(core):
            if out[s] < 0:
                todo = [s]
                while todo:
                    i = todo.pop()
                    if out[i] < 0:
                        out[i] = k
                        if core[i]:
                            todo += np.flatnonzero(near[i] & (out < 0)).tolist()
                k += 1
        if k == 1 or (k == 2 and (out >= 0).all()) or eps > 20:
            return out
        eps += step


def lstm_score(x: np.ndarray, layers: list[dict[str, np.ndarray]], dense: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities of windows (n, time, 1) under stacked bidirectional LSTMs with given weights and a logistic output. Each
    layer has kernels w, u, b for the forward and w2, u2, b2 for the backward direction, gates in order i, f, g, o."""
    sig = lambda z: 1 / (1 + np.exp(-z))

    def run(seq: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = u.shape[0]
        h, c, out = np.zeros((len(seq), n)), np.zeros((len(seq), n)), []
        for t in range(seq.shape[1]):
            z = seq[:, t] @ w + h @ u + b
            i, f, g, o = sig(z[:, :n]), sig(z[:, n : 2 * n]), np.tanh(z[:, 2 * n : 3 * n]), sig(z[:, 3 * n :])
            c = f * c + i * g
            h = o * np.tanh(c)
            out.append(h)
        return np.stack(out, 1)

    for k, p in enumerate(layers):
        forth, back = run(x, p["w"], p["u"], p["b"]), run(x[:, ::-1], p["w2"], p["u2"], p["b2"])
        x = np.concatenate([forth, back[:, ::-1]], -1) if k < len(layers) - 1 else np.concatenate([forth[:, -1], back[:, -1]], -1)
    return sig(x @ dense[0] + dense[1])[:, 0]
