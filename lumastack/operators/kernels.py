"""NumPy kernels over stacks of frames of one shape (n, h, w), for use inside tasks."""

from __future__ import annotations

import numpy as np

#: The B3 spline taps and the gains of an amount of 200 by level.
B3 = np.array([1.0, 4.0, 6.0, 4.0, 1.0]) / 16.0
GAINS = (29.15, 9.48, 0.0, 0.0, 0.0, 0.0)


def mirrored(n: int, by: int) -> np.ndarray:
    """Places 0..n-1 shifted by `by`, mirrored at the first and last one (which are not repeated)."""
    if n == 1:
        return np.zeros(1, int)
    at = np.abs(np.arange(n) + by) % (2 * n - 2)
    return np.where(at < n, at, 2 * n - 2 - at)


def convolve(a: np.ndarray, taps: np.ndarray, axis: int, step: int = 1) -> np.ndarray:
    """Taps `step` apart along an axis, mirrored borders."""
    half = len(taps) // 2
    return sum(t * np.take(a, mirrored(a.shape[axis], (k - half) * step), axis) for k, t in enumerate(taps) if t)


def separable(a: np.ndarray, taps: np.ndarray, step: int = 1) -> np.ndarray:
    return convolve(convolve(a, taps, -2, step), taps, -1, step)


def gauss_taps(sigma: float) -> np.ndarray:
    """Normalised Gaussian taps over four deviations to each side."""
    half = max(1, round(sigma * 8 + 1) // 2)
    t = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    return t / t.sum()


def laplacian(a: np.ndarray) -> np.ndarray:
    """Four neighbours less four times the middle."""
    return convolve(a, np.array([1.0, -2.0, 1.0]), -1) + convolve(a, np.array([1.0, -2.0, 1.0]), -2)


def gradient2(a: np.ndarray) -> np.ndarray:
    """Squared Sobel gradient."""
    d, s = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    return convolve(convolve(a, d, -1), s, -2) ** 2 + convolve(convolve(a, d, -2), s, -1) ** 2


def gray8(a: np.ndarray) -> np.ndarray:
    """Each frame stretched to 0..255, rounded half to even; a flat frame is 0."""
    lo, hi = a.min((-2, -1), keepdims=True), a.max((-2, -1), keepdims=True)
    return np.rint((a - lo) / np.where(hi > lo, hi - lo, 1.0) * 255).astype(int)


def histograms(g: np.ndarray) -> np.ndarray:
    """256 counts for each frame of bytes."""
    n = len(g)
    return np.bincount((g.reshape(n, -1) + 256 * np.arange(n)[:, None]).ravel(), minlength=256 * n).reshape(n, 256)


def otsu(g: np.ndarray) -> np.ndarray:
    """For each frame of bytes the lowest threshold of the largest variance between classes (0 if flat)."""
    h = histograms(g).astype(float)
    n, s = np.cumsum(h, 1), np.cumsum(h * np.arange(256), 1)
    total, whole = n[:, -1:], s[:, -1:]
    rest = n * (total - n)
    between = np.where(rest > 0, (total * s - n * whole) ** 2 / np.where(rest > 0, rest, 1), 0)
    return between.argmax(1)


def triangle(g: np.ndarray) -> np.ndarray:
    """For each frame of bytes the triangle threshold: the bin farthest from the line from the peak to the farther end."""
    out = []
    for h in histograms(g):
        used = np.flatnonzero(h)
        left, right = max(0, used[0] - 1), min(255, used[-1] + 1)
        peak = int(h.argmax())
        flipped = peak - left < right - peak
        if flipped:
            h, left, peak = h[::-1], 255 - right, 255 - peak
        at = np.arange(left, peak + 1)
        distance = h[peak] * (at - left) - (peak - left) * h[at]
        best = int(at[distance.argmax()]) - 1 if len(at) > 1 else left
        out.append(255 - best if flipped else best)
    return np.array(out)


def largest_component(mask: np.ndarray) -> np.ndarray | None:
    """The largest 8-connected part of one mask, or None. Labels spread by the smallest neighbour, with shortcuts."""
    if not mask.any():
        return None
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        padded = np.pad(label, 1, constant_values=h * w)
        low = np.min([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        low = np.where(mask, low, h * w)
        low = np.where(mask, np.minimum(low, np.append(low.ravel(), h * w)[low]), h * w)
        if (low == label).all():
            break
        label = low
    names, counts = np.unique(label[mask], return_counts=True)
    return label == names[counts.argmax()]


def hann(h: int, w: int) -> np.ndarray:
    return np.hanning(h)[:, None] * np.hanning(w)[None, :]


def phase_shift(ref: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """(dx, dy, confidence) by which each frame is displaced against ref: phase correlation, peak refined by centroid."""
    n, h, w = frames.shape
    window = hann(h, w)
    cross = np.conj(np.fft.fft2(ref * window)) * np.fft.fft2(frames * window)
    plane = np.real(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
    return _peaks(plane)


def ncc_shift(ref: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """(dx, dy, confidence) by zero-mean cross-correlation under a Hann window."""
    n, h, w = frames.shape
    window = hann(h, w)
    a = (ref - ref.mean()) * window
    b = (frames - frames.mean((1, 2), keepdims=True)) * window
    plane = np.real(np.fft.ifft2(np.conj(np.fft.fft2(a)) * np.fft.fft2(b)))
    norm = np.sqrt((a * a).sum() * (b * b).sum((1, 2)))
    return _peaks(plane / np.maximum(norm, 1e-12)[:, None, None])


def _peaks(plane: np.ndarray) -> np.ndarray:
    """The highest place of each plane, refined by a parabola in each direction, as a signed shift; and its height."""
    n, h, w = plane.shape
    at = plane.reshape(n, -1).argmax(1)
    y, x, i = at // w, at % w, np.arange(n)

    def refine(low, mid, high):
        curve = low - 2 * mid + high
        return np.clip(np.where(np.abs(curve) > 1e-12, 0.5 * (low - high) / np.where(curve == 0, 1, curve), 0), -1, 1)

    top = plane[i, y, x]
    dx = x + refine(plane[i, y, (x - 1) % w], top, plane[i, y, (x + 1) % w])
    dy = y + refine(plane[i, (y - 1) % h, x], top, plane[i, (y + 1) % h, x])
    return np.stack((np.where(dx > w / 2, dx - w, dx), np.where(dy > h / 2, dy - h, dy), np.clip(top, 0, 1)), 1)


def cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    """The cubic convolution kernel."""
    t = np.abs(t)
    near = (a + 2) * t**3 - (a + 3) * t**2 + 1
    far = a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a
    return np.where(t <= 1, near, np.where(t < 2, far, 0.0))


def remap(frame: np.ndarray, sx: np.ndarray, sy: np.ndarray, border: str = "mirror", clip: bool = True) -> np.ndarray:
    """One frame, or each of a stack, fetched at places (sx, sy) by cubic convolution; border `mirror`, `edge` or `zero`; clipped to 0..1 unless told otherwise."""
    h, w = frame.shape[-2:]
    each = (np.arange(len(frame))[:, None, None],) if frame.ndim == 3 else ()
    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(np.broadcast_shapes(np.shape(sx), np.shape(sy), frame.shape))
    for j in range(-1, 3):
        for i in range(-1, 3):
            x, y = fx + i, fy + j
            weight = cubic(sx - x) * cubic(sy - y)
            if border == "zero":
                weight = weight * ((x >= 0) & (x < w) & (y >= 0) & (y < h))
            if border == "mirror":
                x, y = (np.where((p := np.abs(q) % max(1, 2 * n - 2)) < n, p, 2 * n - 2 - p) for q, n in ((x, w), (y, h)))
            out += weight * frame[(*each, np.clip(y, 0, h - 1), np.clip(x, 0, w - 1))]
    return np.clip(out, 0, 1) if clip else out


def remap_linear(frame: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """One frame, or each of a stack, fetched at places (sx, sy) by linear interpolation; zero outside."""
    h, w = frame.shape[-2:]
    each = (np.arange(len(frame))[:, None, None],) if frame.ndim == 3 else ()
    padded = np.pad(frame, [(0, 0)] * len(each) + [(1, 1)] * 2)
    x, y = np.clip(sx + 1, 0, w + 1), np.clip(sy + 1, 0, h + 1)
    ix, iy = np.minimum(x.astype(int), w), np.minimum(y.astype(int), h)
    tx, ty = x - ix, y - iy
    top = (1 - tx) * padded[(*each, iy, ix)] + tx * padded[(*each, iy, ix + 1)]
    return (1 - ty) * top + ty * ((1 - tx) * padded[(*each, iy + 1, ix)] + tx * padded[(*each, iy + 1, ix + 1)])


def rolloff(h: int, w: int, sigma: float) -> np.ndarray:
    """A Gaussian over frequencies (cycles a pixel), in the order of the transform."""
    f2 = np.fft.fftfreq(h)[:, None] ** 2 + np.fft.fftfreq(w)[None, :] ** 2
    return np.exp(-f2 / (2 * sigma * sigma))


def rolled_off(a: np.ndarray, sigma: float) -> np.ndarray:
    """Frames with high frequencies faded out, clipped to 0..1."""
    return np.clip(np.real(np.fft.ifft2(np.fft.fft2(a) * rolloff(*a.shape[1:], sigma))), 0, 1)


def shift(frame: np.ndarray, dx: float | np.ndarray, dy: float | np.ndarray, border: str = "edge") -> np.ndarray:
    """One frame moved by (dx, dy), or each of a stack by its own, given as (n, 1, 1)."""
    h, w = frame.shape[-2:]
    y, x = np.mgrid[:h, :w].astype(float)
    return remap(frame, x - dx, y - dy, border)


def atrous(a: np.ndarray, levels: int) -> list[np.ndarray]:
    """Details by level and the rest: B3 smoothing with gaps of 1, 2, 4, ... taken from the level before."""
    out = []
    for level in range(levels):
        smooth = separable(a, B3, 1 << level)
        out.append(a - smooth)
        a = smooth
    return [*out, a]


def soft(a: np.ndarray, t: np.ndarray | float) -> np.ndarray:
    """Magnitudes less t, 0 below it."""
    return np.sign(a) * np.maximum(np.abs(a) - t, 0)


def level_gains(amounts: list[float], power: float = 1.0) -> list[float]:
    return [(amount / 200.0) ** power * g for amount, g in zip(amounts, GAINS, strict=False)]


def sharpen(a: np.ndarray, amounts: list[float], power: float = 1.0, denoise: float = 0.0) -> np.ndarray:
    """a plus its details times gains, details under `denoise` times their noise taken off; noise by the median over the brighter half of each frame."""
    n = len(a)
    bright = a > np.median(a.reshape(n, -1), axis=1)[:, None, None]
    out = a.copy()
    for detail, gain in zip(atrous(a, len(amounts)), level_gains(amounts, power), strict=False):
        if gain:
            sigma = np.array([mad_sigma(d, b) for d, b in zip(detail, bright, strict=True)])[:, None, None]
            out += gain * soft(detail, denoise * sigma)
    return np.clip(out, 0, 1)


def mad_sigma(detail: np.ndarray, mask: np.ndarray) -> float:
    """Noise from the median magnitude in the mask (of all, under 10 pixels)."""
    held = detail[mask] if mask.sum() >= 10 else detail
    return float(np.median(np.abs(held)) / 0.6745)


def debayer(raw: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """(n, h, w, 3) from a colour mosaic: each colour is the mean of its samples within one pixel."""
    n, h, w = raw.shape
    y, x = np.mgrid[:h, :w]
    out = np.zeros((n, h, w, 3))
    ones = np.array([1.0, 2.0, 1.0])
    for c, color in enumerate("RGB"):
        mask = np.isin((y % 2) * 2 + x % 2, [i for i, p in enumerate(pattern) if p == color]).astype(float)
        weight = convolve(convolve(mask, ones, -1), ones, -2)
        value = convolve(convolve(raw * mask, ones, -1), ones, -2)
        out[..., c] = np.where(mask > 0, raw, value / np.maximum(weight, 1e-12))
    return out


def poisson_grid(frame: np.ndarray, size: int, part: float, disk: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """(x, y, size) in raster order for three layers of their own: size, 1.5 size to a multiple of 8, and 3 size.

    A place is taken if it lies inside the disk (cx, cy, radius), its patch's mean is at least that part of the frame's
    peak, and it is at least round(35 size / 64) from all places of its layer before it.
    """
    h, w = frame.shape
    cx, cy, radius = disk
    y, x = np.mgrid[:h, :w]
    inside = (x - cx) ** 2 + (y - cy) ** 2 < radius * radius
    total = np.pad(frame, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    least = part * (frame.max() or 1.0)
    out: list[tuple[int, int, int]] = []
    for s in (size, round(size * 1.5 / 8) * 8, size * 3):
        half, gap = s // 2, round(s * 35 / 64)
        d = 2 * half
        if not half or d >= min(h, w):
            continue
        mean = (total[d:h, d:w] + total[: h - d, : w - d] - total[: h - d, d:w] - total[d:h, : w - d]) / (s * s)
        free = (mean >= least) & inside[half : h - half, half : w - half]
        for j, i in np.argwhere(free).tolist():
            if free[j, i]:
                out.append((i + half, j + half, s))
                top, left = max(0, j - gap), max(0, i - gap)
                near = free[top : j + gap + 1, left : i + gap + 1]
                b, a = np.ogrid[top : top + near.shape[0], left : left + near.shape[1]]
                near &= (a - i) ** 2 + (b - j) ** 2 >= gap * gap
    return out
