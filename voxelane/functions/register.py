"""Registration of images and volumes by mutual information, coarse to fine, and their resampling by cubic splines.

A transform is a homogeneous matrix that takes a place in the fixed image to the place in the moving image whose value belongs there.
Every search takes one moving image, or a stack of them, whose searches step side by side.
"""

from __future__ import annotations

import itertools
import json
import math

import numpy as np

from .factor import translation


def spline_coefficients(image: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic spline through all samples, mirrored at the ends, by a pass forth and back along each axis."""
    out = np.asarray(image, float)
    pole = np.sqrt(3.0) - 2
    for axis in range(out.ndim):
        c = np.moveaxis(out, axis, 0).copy()
        n = len(c)
        if n > 1:
            c *= 6.0
            reach = min(n, 30)
            k = np.arange(reach)
            whole = n <= 30
            if whole:  # the mirrored signal's sum in closed form
                w = pole**k + np.where((k > 0) & (k < n - 1), pole ** (2 * n - 2 - k), 0)
                w = w / (1 - pole ** (2 * n - 2))
            else:
                w = pole**k
            c[0] = np.tensordot(w, c[:reach], 1)
            for i in range(1, n):
                c[i] += pole * c[i - 1]
            c[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
            for i in range(n - 2, -1, -1):
                c[i] = pole * (c[i + 1] - c[i])
        out = np.moveaxis(c, 0, axis)
    return out


def sample(image: np.ndarray, places: np.ndarray, order: int = 3) -> np.ndarray:
    """Values at places (axes x ...), cubic or linear between samples, 0 outside."""
    inside = np.all([(p >= 0) & (p <= n - 1) for p, n in zip(places, image.shape)], 0)
    c = spline_coefficients(image) if order == 3 else np.asarray(image, float)
    steps, weights = [], []
    for p, n in zip(places, image.shape):
        p = np.clip(p, 0, n - 1)
        i = np.minimum(np.floor(p).astype(int), max(0, n - 2))
        t = p - i
        if order == 3:
            w = [(1 - t) ** 3 / 6, 2 / 3 - t * t * (2 - t) / 2, 2 / 3 - (1 - t) ** 2 * (1 + t) / 2, t**3 / 6]
            at = [i - 1, i, i + 1, i + 2]
            at = [np.abs(x) for x in at]
            at = [np.where(x > n - 1, 2 * (n - 1) - x, x) % max(1, n) if n > 1 else np.zeros_like(x) for x in at]
        else:
            w, at = [1 - t, t], [i, np.minimum(i + 1, n - 1)]
        steps.append(at)
        weights.append(w)
    out = np.zeros(places.shape[1:])
    for pick in itertools.product(*(range(len(w)) for w in weights)):
        factor = np.prod([weights[d][k] for d, k in enumerate(pick)], 0)
        out += factor * c[tuple(steps[d][k] for d, k in enumerate(pick))]
    return np.where(inside, out, 0.0)


def apply(image: np.ndarray, matrix: np.ndarray, shape: tuple[int, ...] | None = None, order: int = 3) -> np.ndarray:
    """The image resampled: out(p) = image(matrix p)."""
    d = image.ndim
    grid = np.stack(np.meshgrid(*(np.arange(n, dtype=float) for n in shape or image.shape), indexing="ij"))
    places = np.tensordot(matrix[:d, :d], grid, 1) + matrix[:d, d].reshape(-1, *[1] * d)
    return sample(image, places, order)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with repeated edges."""
    out = np.asarray(image, float)
    if sigma <= 0:
        return out
    k = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    g = np.exp(-(k**2) / (2 * sigma**2))
    g /= g.sum()
    for axis in range(out.ndim):
        x = np.moveaxis(out, axis, 0)
        padded = np.pad(x, [(len(k) // 2,) * 2] + [(0, 0)] * (x.ndim - 1), mode="edge")
        out = np.moveaxis(sum(w * padded[i : i + len(x)] for i, w in enumerate(g)), 0, axis)
    return out


def _shares(x: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower bin and the upper one's share of each value, between the least and the largest of its row and 0."""
    lo, hi = np.minimum(x.min(1, initial=np.inf), 0)[:, None], np.maximum(x.max(1, initial=-np.inf), 0)[:, None]
    at = x - lo
    at /= np.where(hi > lo, hi - lo, 1.0)
    at *= bins - 1
    i = at.astype(np.int64)
    np.minimum(i, bins - 2, out=i)
    at -= i
    return i, at


def mutual_information(a: np.ndarray, b: np.ndarray, inside: np.ndarray, bins: int = 32) -> np.ndarray:
    """Of each row of a and the same row of b, where both are known; each value is shared by its two nearest bins, so that small moves
    change it smoothly."""
    (at, s), (j, t) = _shares(np.where(inside, a, 0.0), bins), _shares(np.where(inside, b, 0.0), bins)
    n, cells = len(a), bins * bins
    at *= bins
    at += j
    at += np.arange(n)[:, None] * cells
    at, h = at.ravel(), np.zeros(n * cells)
    for di, wi in ((0, 1 - s), (bins, s)):
        wi *= inside
        for dj, wj in ((0, 1 - t), (1, t)):
            h[di + dj :] += np.bincount(at, weights=(wi * wj).ravel(), minlength=n * cells)[: n * cells - di - dj]
    p = h.reshape(n, bins, bins)
    p /= np.maximum(1, inside.sum(1))[:, None, None]
    q = p.sum(2)[:, :, None] * p.sum(1)[:, None]
    odds = np.ones_like(p)
    np.divide(p, q, out=odds, where=p > 0)
    np.log(odds, out=odds)
    odds *= p
    return odds.reshape(n, cells).sum(1)


def _rotation(angles: np.ndarray, d: int) -> np.ndarray:
    """The rotation of each row of angles."""
    out = np.broadcast_to(np.eye(d), (len(angles), d, d))
    for (i, j), t in zip([(0, 1)] if d == 2 else [(0, 1), (0, 2), (1, 2)], angles.T):
        r = np.broadcast_to(np.eye(d), out.shape).copy()
        r[:, i, i] = r[:, j, j] = np.cos(t)
        r[:, i, j], r[:, j, i] = -np.sin(t), np.sin(t)
        out = out @ r
    return out


#: Numbers of parameters by kind and axes: shifts come first, then angles or the entries of a matrix less the identity.
def parameters(kind: str, d: int) -> int:
    return {"translation": d, "rigid": d + (1 if d == 2 else 3), "affine": d + d * d}[kind]


def matrix_of(kind: str, p: np.ndarray, shape: tuple[int, ...], start: np.ndarray | None = None) -> np.ndarray:
    """The homogeneous matrix of parameters, about the image's middle, after a starting transform; one for each row of parameters."""
    if p.ndim == 1:
        return matrix_of(kind, p[None], shape, start)[0]
    n, d = len(p), len(shape)
    linear = np.broadcast_to(np.eye(d), (n, d, d)) if kind == "translation" else _rotation(p[:, d:], d) if kind == "rigid" else np.eye(d) + p[:, d:].reshape(n, d, d)
    mid = (np.array(shape) - 1) / 2
    out = np.broadcast_to(np.eye(d + 1), (n, d + 1, d + 1)).copy()
    out[:, :d, :d], out[:, :d, d] = linear, mid - linear @ mid + p[:, :d]
    return out if start is None else out @ start


def minimise(f, x: np.ndarray, size: np.ndarray, rounds: int) -> np.ndarray:
    """The simplex method (reflect, expand, contract or shrink) for each row of x by itself: f(rows, points) is the cost of one point of
    each of those rows. A row takes the steps that it would take alone; rows that have ended are left out."""
    n, k = x.shape
    points = np.repeat(x[:, None], k + 1, 1)
    points[:, np.arange(1, k + 1), np.arange(k)] += size
    every = np.arange(n)
    values = np.stack([f(every, points[:, i]) for i in range(k + 1)], 1)
    going = every
    for _ in range(rounds):
        order = np.argsort(values[going], 1, kind="stable")
        at, worth = np.take_along_axis(points[going], order[:, :, None], 1), np.take_along_axis(values[going], order, 1)
        points[going], values[going] = at, worth
        on = (worth[:, -1] - worth[:, 0] >= 1e-7) | ((np.abs(at[:, 1:] - at[:, :1]) / size).max((1, 2)) >= 1e-3)
        going, at, worth = going[on], at[on], worth[on]
        if not len(going):
            break
        mid, worst = at[:, :-1].mean(1), at[:, -1]
        near = mid + (mid - worst)
        v = f(going, near)
        better, kept = v < worth[:, 0], (v >= worth[:, 0]) & (v < worth[:, -2])
        second = np.where(better[:, None], mid + 2 * (mid - worst), mid + 0.5 * (np.where((v < worth[:, -1])[:, None], near, worst) - mid))
        w = np.full(len(going), np.inf)
        if not kept.all():
            w[~kept] = f(going[~kept], second[~kept])
        far, inner = better & (w < v), ~better & ~kept & (w < np.minimum(v, worth[:, -1]))
        take, reflect = far | inner, (better & ~far) | kept
        points[going[take], -1], values[going[take], -1] = second[take], w[take]
        points[going[reflect], -1], values[going[reflect], -1] = near[reflect], v[reflect]
        rest = ~take & ~reflect
        if rest.any():
            rows, best = going[rest], at[rest][:, :1]
            points[rows] = best + 0.5 * (at[rest] - best)
            points[rows, 0] = best[:, 0]
            for i in range(1, k + 1):
                values[rows, i] = f(rows, points[rows, i])
    return points[every, values.argmin(1)]


def _linear(images: np.ndarray, which: np.ndarray, shape: tuple[int, ...], places: np.ndarray) -> np.ndarray:
    """Values of images (rows of flat samples) at places (image, axes, place), linear between samples; places outside are clipped."""
    at, corners = None, [(0, None)]
    for axis, n in enumerate(shape):
        t = np.maximum(places[:, axis], 0)
        np.minimum(t, n - 1, out=t)
        i = t.astype(np.int64)
        np.minimum(i, max(0, n - 2), out=i)
        t -= i
        step = math.prod(shape[axis + 1 :])
        i *= step
        at = i if at is None else np.add(at, i, out=at)
        corners = [(a + e, g if w is None else w * g) for a, w in corners for e, g in ((0, 1 - t), (step if n > 1 else 0, t))]
    at += which[:, None] * images.shape[1]
    flat, out = images.ravel(), np.zeros(at.shape)
    for a, w in corners:
        out += flat[a:].take(at) * w
    return out


#: Samples of images whose transforms are searched together: enough for NumPy to be busy, few enough for a core's cache.
TOGETHER = 1 << 14


def estimate(kind: str, fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None, factors: tuple[int, ...] = (4, 2, 1), rounds: int = 200, bins: int = 32) -> np.ndarray:
    """The transform of a kind (translation, rigid or affine) for which moving, resampled, tells most about fixed, searched on images
    blurred and thinned less and less. Levels at which the images would have fewer than eight samples an axis are left out. With one
    axis more, moving is a stack of images, each with a transform (and a start) of its own; they are searched together."""
    d = fixed.ndim
    if moving.ndim == d:
        return estimate(kind, fixed, moving[None], start, factors, rounds, bins)[0]
    begin = np.broadcast_to(np.eye(d + 1) if start is None else np.asarray(start, float), (len(moving), d + 1, d + 1))
    most = max(1, TOGETHER // max(1, fixed.size))
    if len(moving) > most:
        return np.concatenate([estimate(kind, fixed, moving[a : a + most], begin[a : a + most], factors, rounds, bins) for a in range(0, len(moving), most)])
    p = np.zeros((len(moving), parameters(kind, d)))
    reach = np.r_[np.ones(d), np.full(p.shape[1] - d, 0.05)]
    shape = moving.shape[1:]
    for factor in factors:
        if factor > 1 and min(fixed.shape) // factor < 8:
            continue
        width = factor / 2 if factor > 1 else 0
        smooth, target = np.stack([blur(m, width).ravel() for m in moving]), blur(fixed, width)
        picks = np.stack(np.meshgrid(*(np.arange(0, n, factor, dtype=float) for n in fixed.shape), indexing="ij")).reshape(d, -1)
        values = target[tuple(slice(0, n, factor) for n in fixed.shape)].ravel()
        few = min(bins, max(8, values.size // 64))

        def cost(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
            m = matrix_of(kind, q, fixed.shape, begin[rows])  # noqa: B023
            places = m[:, :d, :d] @ picks  # noqa: B023
            places += m[:, :d, d:]
            inside = np.ones((len(rows), places.shape[2]), bool)
            for axis, n in enumerate(shape):
                inside &= places[:, axis] >= 0
                inside &= places[:, axis] <= n - 1
            seen = _linear(smooth, rows, shape, places)  # noqa: B023
            found = -mutual_information(seen, np.broadcast_to(values, seen.shape), inside, few)  # noqa: B023
            return np.where(inside.mean(1) < 0.25, 0.0, found)

        p = minimise(cost, p, reach * max(1, factor / 2), rounds)
    return matrix_of(kind, p, fixed.shape, begin)


def by_shift(fixed: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """The transform of the shift that phase correlation finds, to start from; of two axes. A stack of images has one each."""
    if moving.ndim > fixed.ndim:
        return np.stack([by_shift(fixed, m) for m in moving])
    out = np.eye(3)
    out[:2, 2] = translation(moving, fixed)
    return out


def translation2d(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    return estimate("translation", fixed, moving, by_shift(fixed, moving) if start is None else start)


def rigid2d(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    return estimate("rigid", fixed, moving, translation2d(fixed, moving) if start is None else start)


def affine2d(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    return estimate("affine", fixed, moving, rigid2d(fixed, moving) if start is None else start)


def lifted(matrix: np.ndarray) -> np.ndarray:
    """A transform of planes as one of volumes, whose first axis it leaves."""
    out = np.broadcast_to(np.eye(4), (*matrix.shape[:-2], 4, 4)).copy()
    out[..., 1:, 1:] = matrix
    return out


def translation3d(fixed: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Volumes (z, x, y): first the shift of their mean planes."""
    return estimate("translation", fixed, moving, lifted(translation2d(fixed.mean(-3), moving.mean(-3))))


def rigid3d(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    return estimate("rigid", fixed, moving, lifted(rigid2d(fixed.mean(-3), moving.mean(-3))) if start is None else start)


def affine3d(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    return estimate("affine", fixed, moving, lifted(affine2d(fixed.mean(-3), moving.mean(-3))) if start is None else start)


def rigid_projected(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The rigid transform of the mean planes of two volumes, as one of volumes."""
    plane = None if start is None else (start[..., 1:, 1:] if start.shape[-1] == 4 else start)
    return lifted(rigid2d(fixed.mean(-3), moving.mean(-3), plane))


def rigid_in_planes(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Rigid within planes, from the mean planes, with a shift across them that is found after the planes are aligned."""
    out = (lifted(rigid2d(fixed.mean(-3), moving.mean(-3))) if start is None else np.asarray(start, float)).copy()
    one = moving.ndim == 3
    aligned = apply(moving, out, fixed.shape, 1) if one else np.stack([apply(v, m, fixed.shape, 1) for v, m in zip(moving, np.broadcast_to(out, (len(moving), 4, 4)))])
    across = (..., slice(None), *(slice(n // 8, n - n // 8) for n in fixed.shape[1:]))
    shift = estimate("translation", fixed[across], aligned[across], factors=(1,))
    out = out if one else np.broadcast_to(out, shift.shape).copy()
    out[..., 0, 3] += shift[..., 0, 3]
    return out


def to_text(matrix: np.ndarray) -> str:
    """A transform as JSON, whose numbers come back as they were."""
    return json.dumps(np.asarray(matrix, float).tolist())


def from_text(text: str) -> np.ndarray:
    return np.array(json.loads(text), float)
