"""Outlines of bright disks: closing, outer boundaries and least-squares ellipses of whole stacks of frames."""

from __future__ import annotations

import numpy as np

from lumastack.operators import kernels

#: Pixels whose parts are looked for together.
TOGETHER = 1_000_000
#: Side of the round structuring element that closes gaps in a disk.
CLOSING = 7


def round_element(side: int = CLOSING) -> list[tuple[int, int]]:
    """(dy, reach) of each row of a disk-shaped element: the row covers dx from -reach to reach."""
    r = side // 2
    return [(dy, round(r * np.sqrt(1 - (dy / r) ** 2))) for dy in range(-r, r + 1)]


def dilate(masks: np.ndarray, side: int = CLOSING) -> np.ndarray:
    """Each pixel of n masks set if the element around it meets the mask; nothing outside a frame counts."""
    n, h, w = masks.shape
    r = side // 2
    runs = np.cumsum(np.pad(masks, ((0, 0), (0, 0), (r + 1, r))), axis=2, dtype=np.int32)  # a row's set pixels up to each place
    out = np.zeros_like(masks)
    for dy, reach in round_element(side):
        lit = runs[:, :, r + 1 + reach : r + 1 + reach + w] > runs[:, :, r - reach : r - reach + w]
        out[:, max(0, -dy) : h - max(0, dy)] |= lit[:, max(0, dy) : h - max(0, -dy)]
    return out


def close(masks: np.ndarray, side: int = CLOSING) -> np.ndarray:
    """Gaps smaller than the element filled: what is dilated, eroded again. Outside a frame nothing wears a mask away."""
    return ~dilate(~dilate(masks, side), side)


def parts(masks: np.ndarray, *, corners: bool) -> np.ndarray:
    """The connected parts of n masks, each pixel labelled by the smallest place in its part (size of all masks: not set).

    Labels spread to neighbours in all masks at once, and each label is followed to its own label, so rounds stay few.
    """
    n, h, w = masks.shape
    none = masks.size
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (corners or not (dy and dx))]
    label = np.where(masks, np.arange(none).reshape(masks.shape), none)
    while True:
        padded = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=none)
        low = label.copy()
        for dy, dx in steps:
            np.minimum(low, padded[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], out=low)
        low[~masks] = none
        follow = np.append(low.ravel(), none)
        for _ in range(3):
            low = follow[low]
        if (low == label).all():
            return label
        label = low


def outlines(masks: np.ndarray) -> list[np.ndarray | None]:
    """For each mask the outer boundary pixels, as (x, y), of the part whose outline encloses the largest area; None without any part.

    The boundary of a part are its pixels with a side on the background that reaches the frame's edge, so holes, and what lies in
    them, do not count. The area within the pixels' centres follows from their numbers: pixels inside and half of those on it, less one.
    """
    free = parts(np.pad(~masks, ((0, 0), (1, 1), (1, 1)), constant_values=True), corners=False)
    outside = free == free[:, :1, :1]
    filled = ~outside[:, 1:-1, 1:-1]
    edge = masks & (outside[:, :-2, 1:-1] | outside[:, 2:, 1:-1] | outside[:, 1:-1, :-2] | outside[:, 1:-1, 2:])
    whole = parts(filled, corners=True)
    names, inside = np.unique(whole[filled], return_counts=True)
    on = np.bincount(np.searchsorted(names, whole[edge]), minlength=len(names))
    area, frame, found = inside - on / 2 - 1, names // max(1, masks[0].size), []
    for k in range(len(masks)):
        i, j = np.searchsorted(frame, (k, k + 1))
        if i == j:
            found.append(None)
            continue
        y, x = np.nonzero(edge[k] & (whole[k] == names[i + int(np.argmax(area[i:j]))]))
        found.append(np.column_stack((x, y)))
    return found


def fit_ellipse(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """(cx, cy, semi-major, semi-minor, angle of the major axis in degrees from x) of the ellipse of least squares through points; None
    where they lie on no ellipse.

    A conic through the points, about their mean and in units of their spread, has its centre where its gradient vanishes; a second
    fit about that centre has three coefficients only, and its quadratic form the axes.
    """
    middle = points.mean(0)
    spread = np.abs(points - middle).max()
    if len(points) < 5 or not spread:
        return None
    x, y = ((points - middle) / spread).T
    a, b, c, d, e = np.linalg.lstsq(np.column_stack((x * x, x * y, y * y, x, y)), np.ones(len(x)), rcond=None)[0]
    form = np.array([[2 * a, b], [b, 2 * c]])
    if np.linalg.det(form) <= 1e-9:
        return None
    centre = np.linalg.solve(form, [-d, -e])
    x, y = x - centre[0], y - centre[1]
    a, b, c = np.linalg.lstsq(np.column_stack((x * x, x * y, y * y)), np.ones(len(x)), rcond=None)[0]
    values, vectors = np.linalg.eigh([[a, b / 2], [b / 2, c]])
    if values[0] <= 1e-9:
        return None
    long, short = spread / np.sqrt(values)
    cx, cy = middle + spread * centre
    return cx, cy, long, short, np.degrees(np.arctan2(vectors[1, 0], vectors[0, 0])) % 180


def lit(stack: np.ndarray, margin: float = 0.1, fixed: int = 0) -> np.ndarray:
    """The mask of each frame: bytes over a fixed threshold; or, stretched to the frame's own range (so that an even background is 0), over
    Otsu's less a margin for the dim limb."""
    if fixed > 0:
        return np.floor(np.clip(stack, 0, 1) * 255) > fixed
    g = kernels.gray8(stack)
    return g > np.maximum(1, kernels.otsu(g) * (1 - margin))[:, None, None]


def ellipses(stack: np.ndarray, margin: float = 0.1, fixed: int = 0) -> dict[str, np.ndarray]:
    """Centre, half axes and angle of the bright disk of each frame of a stack: the ellipse through the outline of the largest part.

    Where no ellipse fits (fewer than five pixels, a line), the box around the outline; where nothing is lit, a circle of a
    quarter of the frame in its middle.
    """
    h, w = stack.shape[1:]
    rows, each = [], max(1, TOGETHER // (h * w))
    masks = lit(stack, margin, fixed)
    for points in (o for i in range(0, len(masks), each) for o in outlines(close(masks[i : i + each]))):
        if points is None:
            rows.append((w / 2, h / 2, min(h, w) / 4, min(h, w) / 4, 0.0))
            continue
        low, size = points.min(0), np.ptp(points, axis=0) + 1
        rows.append(fit_ellipse(points) or (*(low + size / 2), size.max() / 2, size.min() / 2, 0.0))
    return {k: np.array([r[i] for r in rows]) for i, k in enumerate(("cx", "cy", "semi_major", "semi_minor", "angle"))}
