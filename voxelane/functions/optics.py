"""Noise correction of whole images: optical filters, tiles with margins, point spread functions."""

from __future__ import annotations

import numpy as np

from .factor import noise_corrected


def radius(n: int, pixel: float) -> np.ndarray:
    """Spatial frequency of each place of a spectrum of n x n samples, the zero frequency in the middle."""
    x = np.arange(-n / 2, n / 2)
    return np.hypot(x[None], x[:, None]) / (n * pixel)


def point_spread(n: int, pixel: float, aperture: float, wavelength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point spread, pupil, transfer function) of a pupil that grows with frequency up to aperture / wavelength; the first sums to
    1, the last has a maximum of 1."""
    pupil = radius(n, pixel)
    pupil[pupil > aperture / wavelength] = 0
    amplitude = np.fft.fftshift(np.fft.fft2(pupil))
    spread = (amplitude * amplitude.conj()).real
    transfer = np.abs(np.fft.fftshift(np.fft.ifft2(spread)))
    return spread / spread.sum(), pupil, transfer / transfer.max()


def roll_off(kind: str, aperture: float, wavelength: float, pixel: float = 1.0, width: float = 1.0, height: float = 0.7) -> tuple[float, float]:
    """(share of the roll-off, period) of a raised cosine: pure (noise beyond the aperture alone), weighted (by the transfer
    function), or adjustable, of the given height at width times the aperture's frequency."""
    if kind == "pure":
        return 0.2, (1 - 0.2) * wavelength / 4 / aperture
    if kind == "weighted":
        return 1.0, wavelength / 4 / aperture / 1.4
    if kind != "adjustable":
        raise ValueError("kind is pure, weighted or adjustable")
    at = width * aperture / wavelength
    bend = np.pi / 2 * (1 / np.sqrt(2) / pixel / at - 1)
    share = bend / (np.arccos(1 - 2 * height) + bend)
    return float(share), float((1 - share) / at / 2)


def high_pass(n: int, pixel: float, aperture: float, wavelength: float, kind: str = "weighted", width: float = 1.0, height: float = 0.7) -> np.ndarray:
    """1 less a raised cosine over spatial frequency: what it lets through is noise."""
    k = radius(n, pixel)
    share, period = roll_off(kind, aperture, wavelength, pixel, width, height)
    low, high = (1 - share) / 2 / period, (1 + share) / 2 / period
    pass_ = 0.5 * (1 + np.cos(np.pi * period / share * (k - low)))
    return 1 - np.where(k < low, 1.0, np.where(k > high, 0.0, pass_))


def tiles_with_margin(image: np.ndarray, size: int) -> np.ndarray:
    """(tile, size + 2, size + 2): square tiles of a square image, columns of tiles after each other, each with a margin of one pixel
    from its neighbours, repeated at the image's edge. Pixels beyond the last whole tile are left out."""
    k = len(image) // size
    padded = np.pad(image[: k * size, : k * size], 1, mode="edge")
    return np.stack([padded[i * size : (i + 1) * size + 2, j * size : (j + 1) * size + 2] for j in range(k) for i in range(k)])


def tiles(image: np.ndarray, size: int) -> np.ndarray:
    """(tile, size, size) without margins, columns of tiles after each other."""
    k = len(image) // size
    return np.stack([image[i * size : (i + 1) * size, j * size : (j + 1) * size] for j in range(k) for i in range(k)])


def stitched(parts: np.ndarray) -> np.ndarray:
    """The image whose tiles with margins these are."""
    k = int(round(len(parts) ** 0.5))
    return np.hstack([np.vstack([p[1:-1, 1:-1] for p in parts[j * k : (j + 1) * k]]) for j in range(k)])


def bridged(image: np.ndarray, margin: int, axis: int | None = None) -> np.ndarray:
    """Margins between the values of the first and the last row, in steps of a (2 margin + 1)-th of their difference from the first: 1,
    margin, margin - 1, ... 2 steps before the image and margin + 1, ... 2 margin after it; along one axis, or both."""
    if axis is None:
        return bridged(bridged(image, margin, 0), margin, 1)
    x = np.swapaxes(image, axis, 0)
    step = (x[-1] - x[0]) / (2 * margin + 1)
    before = [x[0] + k * step for k in (1, *range(margin, 1, -1))][:margin]
    after = [x[0] + k * step for k in range(margin + 1, 2 * margin + 1)]
    before, after = (np.stack(e) if e else x[:0] for e in (before, after))
    return np.swapaxes(np.concatenate([before, x, after]), axis, 0)


def reduce_noise(image: np.ndarray, var: np.ndarray, gain: np.ndarray, size: int, pixel: float, aperture: float, wavelength: float, alpha: float, rounds: int = 200, kind: str = "weighted", width: float = 1.0, height: float = 0.7) -> np.ndarray:
    """Noise correction of an image of any shape in square tiles with margins; the image is brought to a square of whole tiles first."""
    nx, ny = image.shape
    side = -(-max(nx, ny) // size) * size

    def square(x: np.ndarray, fill: float = 0.0) -> np.ndarray:
        out = np.full((side, side), fill)
        out[:nx, :ny] = x
        return out

    data = square(image)
    data[data <= 0] = 1e-6
    mask = high_pass(size + 2, pixel, aperture, wavelength, kind, width, height)
    parts = [noise_corrected(u, v, g, mask, alpha, rounds) for u, v, g in zip(tiles_with_margin(data, size), tiles_with_margin(square(var), size), tiles_with_margin(square(gain), size))]
    out = stitched(np.stack(parts))
    return np.maximum(out, 1e-6)[:nx, :ny]


def localisations(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """1 where any of the points lies."""
    out = np.zeros((nx, ny))
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    ok = (i >= 0) & (i < nx) & (j >= 0) & (j < ny)
    out[i[ok], j[ok]] = 1
    return out


def ideal_image(x: np.ndarray, y: np.ndarray, n: int, pixel: float, zoom: int, aperture: float, wavelength: float) -> tuple[np.ndarray, np.ndarray]:
    """(the image of points through the optics, binned by zoom; the kernel): points are scaled to fill n * zoom samples."""
    size = n * zoom
    x, y = np.round(x - x.min()), np.round(y - y.min())
    scale = max(x.max(), y.max()) / size
    points = localisations(x / scale, y / scale, size, size)
    spread = point_spread(size, pixel / zoom, aperture, wavelength)[0]
    half, mid = zoom * 5 // 2, size // 2
    kernel = spread[mid - half : mid + half, mid - half : mid + half]
    whole = np.fft.irfft2(np.fft.rfft2(points, [2 * size] * 2) * np.fft.rfft2(kernel, [2 * size] * 2), [2 * size] * 2)
    at = (kernel.shape[0] - 1) // 2
    image = np.abs(whole[at : at + size, at : at + size].T)
    return (image.reshape(n, zoom, n, zoom).sum((1, 3)) / zoom if zoom > 1 else image), kernel
