"""A bidirectional LSTM over windows of a trace: scoring and training with Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def create(hidden: int, inputs: int = 1, seed: int = 0) -> dict[str, np.ndarray]:
    """Two bidirectional layers, of `hidden` and half as many units a direction, and a logistic output. Gates in order i, f, g, o; the
    forget gate starts open."""
    rng = np.random.default_rng(seed)
    uniform = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    out: dict[str, np.ndarray] = {}
    for layer, (n, m) in enumerate(((hidden, inputs), (max(1, hidden // 2), 2 * hidden))):
        for way in "fb":
            bias = np.zeros(4 * n)
            bias[n : 2 * n] = 1
            u = np.hstack([np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(4)])
            out |= {f"w{layer}{way}": uniform(m, 4 * n), f"u{layer}{way}": u, f"b{layer}{way}": bias}
    n = 2 * max(1, hidden // 2)
    return out | {"w": uniform(n, 1), "b": np.zeros(1)}


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    n, steps = len(u), []
    h = c = np.zeros((len(x), n))
    out = np.empty((*x.shape[:2], n))
    for t in range(x.shape[1]):
        z = x[:, t] @ w + h @ u + b
        i, f, g, o = sigmoid(z[:, :n]), sigmoid(z[:, n : 2 * n]), np.tanh(z[:, 2 * n : 3 * n]), sigmoid(z[:, 3 * n :])
        before, hidden = c, h
        c = f * c + i * g
        h = o * np.tanh(c)
        out[:, t] = h
        steps.append((i, f, g, o, before, c, hidden))
    return out, steps


def _back(x: np.ndarray, w: np.ndarray, u: np.ndarray, steps: list, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(u)
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * n), np.empty_like(x)
    dh = dc = np.zeros((len(x), n))
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, g, o, before, c, hidden = steps[t]
        dh = dh + d[:, t]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)])
        dw += x[:, t].T @ dz
        du += hidden.T @ dz
        db += dz.sum(0)
        dx[:, t] = dz @ w.T
        dh, dc = dz @ u.T, dc * f
    return dw, du, db, dx


def _layers(x: np.ndarray, p: dict[str, np.ndarray], drop: np.ndarray | None = None):
    seen = []
    for layer in (0, 1):
        forth, a = _run(x, *(p[f"{k}{layer}f"] for k in "wub"))
        back, b = _run(x[:, ::-1], *(p[f"{k}{layer}b"] for k in "wub"))
        seen.append((x, a, b))
        x = np.concatenate([forth, back[:, ::-1]], -1)
        if not layer and drop is not None:
            x = x * drop
    half = x.shape[2] // 2
    return np.concatenate([x[:, -1, :half], x[:, 0, half:]], -1), seen


def score(windows: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities of windows (n, time) or (n, time, inputs)."""
    x = windows[..., None] if windows.ndim == 2 else windows
    last, _ = _layers(np.asarray(x, float), p)
    return sigmoid(last @ p["w"] + p["b"])[:, 0]


def gradient(windows: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray], drop: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss of windows with labels y, and its gradient."""
    x = np.asarray(windows[..., None] if windows.ndim == 2 else windows, float)
    last, seen = _layers(x, p, drop)
    s = sigmoid(last @ p["w"] + p["b"])[:, 0]
    loss = -float(np.mean(y * np.log(s + 1e-12) + (1 - y) * np.log(1 - s + 1e-12)))
    d = ((s - y) / len(y))[:, None]
    out = {"w": last.T @ d, "b": d.sum(0)}
    d = d @ p["w"].T
    half, steps = d.shape[1] // 2, x.shape[1]
    forth, back = np.zeros((len(y), steps, half)), np.zeros((len(y), steps, half))
    forth[:, -1], back[:, -1] = d[:, :half], d[:, half:]  # the backward pass ends at the first sample
    for layer in (1, 0):
        inputs, a, b = seen[layer]
        dwf, duf, dbf, dxf = _back(inputs, p[f"w{layer}f"], p[f"u{layer}f"], a, forth)
        dwb, dub, dbb, dxb = _back(inputs[:, ::-1], p[f"w{layer}b"], p[f"u{layer}b"], b, back)
        out |= {f"w{layer}f": dwf, f"u{layer}f": duf, f"b{layer}f": dbf, f"w{layer}b": dwb, f"u{layer}b": dub, f"b{layer}b": dbb}
        if layer:
            dx = dxf + dxb[:, ::-1]
            dx = dx * drop if drop is not None else dx
            half = dx.shape[2] // 2
            forth, back = dx[:, :, :half], dx[:, ::-1, half:]
    return loss, out


def train(windows: np.ndarray, y: np.ndarray, hidden: int = 16, passes: int = 10, batch: int = 64, rate: float = 1e-2, dropout: float = 0.2, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights fitted to windows and labels by Adam, with dropout between the layers."""
    rng, p = np.random.default_rng(seed), create(hidden, 1 if windows.ndim == 2 else windows.shape[2], seed)
    first, second, k = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0
    for _ in range(passes):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            at = order[a : a + batch]
            drop = (rng.random((len(at), 1, 2 * hidden)) >= dropout) / (1 - dropout) if dropout else None
            _, g = gradient(windows[at], y[at], p, drop)
            k += 1
            for n in p:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
                p[n] = p[n] - rate * first[n] / (1 - 0.9**k) / (np.sqrt(second[n] / (1 - 0.999**k)) + 1e-8)
    return p
