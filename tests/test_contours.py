"""Closing, outlines and ellipses of disks against plain loops, and ellipses of known shape."""

import numpy as np
import pytest

from lumastack.operators import contours
from lumastack.operators import frames as fr


def ellipse_mask(cx, cy, a, b, degrees, shape=(80, 96)):
    y, x = np.mgrid[: shape[0], : shape[1]]
    t = np.radians(degrees)
    u, v = (x - cx) * np.cos(t) + (y - cy) * np.sin(t), (y - cy) * np.cos(t) - (x - cx) * np.sin(t)
    return (u / a) ** 2 + (v / b) ** 2 <= 1


def plain_close(mask):
    """Pixel by pixel, with the offsets that the element covers."""
    offsets = [(dy, dx) for dy, reach in [(-3, 0), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 0)] for dx in range(-reach, reach + 1)]
    h, w = mask.shape

    def around(m, y, x):
        return [m[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < h and 0 <= x + dx < w]

    big = np.array([[any(around(mask, y, x)) for x in range(w)] for y in range(h)])
    return np.array([[all(around(big, y, x)) for x in range(w)] for y in range(h)])


def plain_outline(mask):
    """The outline by walking around each part, clockwise, and the polygon's area by the shoelace rule; of the largest outer one."""
    h, w = mask.shape
    turn = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    at = lambda y, x: 0 <= y < h and 0 <= x < w and mask[y, x]
    free, edge = set(), [(-1, -1)]  # the background that reaches the edge
    while edge:
        y, x = edge.pop()
        if (y, x) in free or not (-1 <= y <= h and -1 <= x <= w) or at(y, x):
            continue
        free.add((y, x))
        edge += [(y + dy, x + dx) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    best, seen = (-1.0, None), set()
    for y in range(h):
        for x in range(w):
            if not mask[y, x] or (y, x - 1) not in free or (y, x) in seen:
                continue
            path, now, back = [(y, x)], (y, x), 4  # the background is to the left
            while True:
                for k in range(1, 9):
                    d = (back + k) % 8
                    step = (now[0] + turn[d][0], now[1] + turn[d][1])
                    if at(*step):
                        break
                else:
                    break
                if now == (y, x) and len(path) > 1 and step == path[1]:
                    break
                path.append(step)
                now, back = step, (d + 4) % 8
            path = path[:-1] if len(path) > 1 else path
            seen |= set(path)
            ys, xs = np.array(path, float).T
            area = abs(np.sum(xs * np.roll(ys, -1) - ys * np.roll(xs, -1))) / 2
            best = max(best, (area, sorted({(b, a) for a, b in path})), key=lambda v: v[0])
    return best[1]


def shapes():
    r = np.random.default_rng(6)
    ring = ellipse_mask(40, 40, 25, 20, 0) & ~ellipse_mask(40, 40, 15, 12, 0) | ellipse_mask(40, 40, 6, 6, 0)
    notched = ellipse_mask(45, 40, 30, 22, 35)
    notched[38:42, 60:] = False
    comb = np.zeros((20, 30), bool)
    comb[2, 2:28], comb[3:9, 4:27:2], comb[14:18, 5:20] = True, True, True
    noise = [r.random((24, 31)) < p for p in (0.1, 0.4, 0.6)]
    return [ring, notched, ellipse_mask(5, 10, 30, 25, 20), np.ones((9, 9), bool), np.eye(7, dtype=bool), comb, *noise]


@pytest.mark.parametrize("k", range(9))
def test_closing_and_outline_equal_plain_loops(k):
    mask = shapes()[k]
    assert (contours.close(mask[None])[0] == plain_close(mask)).all()
    closed = contours.close(mask[None])[0]
    assert sorted(map(tuple, contours.outlines(closed[None])[0].tolist())) == plain_outline(closed)
    if k not in (5, 7, 8):  # thin parts of a comb or of noise may enclose like areas
        assert sorted(map(tuple, contours.outlines(mask[None])[0].tolist())) == plain_outline(mask)


@pytest.mark.parametrize(("a", "b", "degrees"), [(30, 20, 0), (30, 20, 35), (30, 20, 90), (28, 26, 120), (31, 12, 170)])
def test_ellipses_of_tilted_disks(a, b, degrees):
    image = ellipse_mask(47.3, 39.6, a, b, degrees) * 0.8
    e = {k: v[0] for k, v in contours.ellipses(image[None]).items()}
    assert abs(e["cx"] - 47.3) < 0.3 and abs(e["cy"] - 39.6) < 0.3 and abs(e["semi_major"] - a) < 0.6 and abs(e["semi_minor"] - b) < 0.6
    off = (e["angle"] - degrees) % 180
    assert min(off, 180 - off) < (6 if a - b < 5 else 1.5) and 0 <= e["angle"] < 180


def test_gaps_smaller_than_the_element_do_not_count():
    whole, notched = ellipse_mask(47, 40, 30, 22, 35), ellipse_mask(47, 40, 30, 22, 35)
    notched[38:43, 40:] = False
    one, two = (contours.ellipses(m[None] * 0.7) for m in (whole, notched))
    assert all(abs(one[k][0] - two[k][0]) < 0.6 for k in ("cx", "cy", "semi_major", "semi_minor"))
    assert abs(np.nonzero(notched)[1].mean() - one["cx"][0]) > 0.6  # a centre of gravity moves


def test_a_disk_that_the_frame_cuts_off_is_fitted_by_its_arc_and_chord():
    mask = ellipse_mask(10, 40, 30, 30, 0)
    points = np.array(plain_outline(mask), float)
    middle = points.mean(0)
    x, y = (points - middle).T
    a, b, c, d, e = np.linalg.lstsq(np.column_stack((x * x, x * y, y * y, x, y)), np.ones(len(x)), rcond=None)[0]
    want = np.linalg.solve([[2 * a, b], [b, 2 * c]], [-d, -e]) + middle
    got = contours.ellipses(mask[None] * 0.9)
    assert np.allclose((got["cx"][0], got["cy"][0]), want, atol=1e-6)


def test_holes_and_what_lies_in_them_do_not_count():
    ring = shapes()[0]
    full = ellipse_mask(40, 40, 25, 20, 0)
    assert all(np.allclose(contours.ellipses(ring[None] * 0.8)[k], contours.ellipses(full[None] * 0.8)[k]) for k in ("cx", "cy", "semi_major"))


def test_degenerate_disks_and_thresholds(spark):
    line, dot = np.zeros((40, 40)), np.zeros((40, 40))
    line[20, 5:30], dot[7, 9] = 0.9, 0.9
    e = contours.ellipses(np.stack([line, dot, np.zeros((40, 40))]), fixed=100)
    assert e["cx"].tolist() == [17.5, 9.5, 20] and e["cy"].tolist() == [20.5, 7.5, 20] and e["semi_major"].tolist() == [12.5, 0.5, 10]
    image = ellipse_mask(40, 40, 25, 25, 0, (80, 80)) * 0.3 + ellipse_mask(40, 40, 10, 10, 0, (80, 80)) * 0.6
    assert abs(contours.ellipses(image[None], fixed=20)["semi_major"][0] - 25) < 0.6 and abs(contours.ellipses(image[None], fixed=120)["semi_major"][0] - 10) < 0.6
    rows = [(i, 40, 40, a.ravel().tolist()) for i, a in enumerate((line, dot))]
    df = spark.createDataFrame(rows, "frame_id long, h int, w int, px array<double>")
    got = {r["frame_id"]: r for r in fr.disk_ellipse(df, fixed=100).collect()}
    assert got[1]["cx"] == 9.5 and fr.disk_ellipse(df.limit(0)).count() == 0
    assert [r["n_lit"] for r in fr.closed_disks(df, fixed=100).orderBy("frame_id").collect()] == [25, 1]


def test_frames_of_a_stack_do_not_meet(monkeypatch):
    r = np.random.default_rng(2)
    stack = r.random((40, 17, 13)) * (r.random((40, 1, 1)) > 0.2)
    alone = [contours.ellipses(a[None], fixed=190) for a in stack]
    for together in (1, 500, 1_000_000):
        monkeypatch.setattr(contours, "TOGETHER", together)
        whole = contours.ellipses(stack, fixed=190)
        assert all(np.allclose(whole[k], [e[k][0] for e in alone]) for k in whole)
