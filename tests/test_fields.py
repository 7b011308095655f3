"""Fields, resampled frames and patch stacks against the rules pixel by pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.operators import fields, kernels


def plain_field(points, h, w, sigma):
    reach, out = int(3 * sigma) + 1, np.zeros((2, h, w))
    weight = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            for ax, ay, dx, dy, conf in points:
                if abs(x - ax) <= reach and abs(y - ay) <= reach:
                    g = np.exp(-((x - ax) ** 2 + (y - ay) ** 2) / (2 * sigma**2))
                    weight[y, x] += g * conf
                    out[0, y, x] += g * conf * conf * dx
                    out[1, y, x] += g * conf * conf * dy
    sure = (weight >= 0.05 * weight.max()) & (len(points) >= 3) & (weight > 0)
    return np.where(sure, out / np.where(sure, weight, 1), 0)


def point_rows(r, frames=4):
    rows = [(i, int(r.integers(0, 20)), int(r.integers(0, 14)), float(r.normal()), float(r.normal()), float(r.random())) for i in range(frames) for _ in range(6 if i != 1 else 2)]
    return rows, {i: [p[1:] for p in rows if p[0] == i] for i in range(frames)}


def test_fields_equal_sums_over_points(spark):
    rows, own = point_rows(np.random.default_rng(1))
    df = spark.createDataFrame(rows, "frame_id long, ax int, ay int, dx double, dy double, conf double").repartition(3)
    for sigma in (0.8, 2.5):
        got = {r["frame_id"]: r for r in fields.warp_fields(df, 14, 20, sigma).collect()}
        assert set(got) == set(own)
        for i, points in own.items():
            assert np.allclose(np.reshape([got[i]["dx"], got[i]["dy"]], (2, 14, 20)), plain_field(points, 14, 20, sigma), atol=1e-9)
    assert np.count_nonzero(got[1]["dx"]) == 0
    flat = fields.warp_field(df, 14, 20, 2.5).where("frame_id = 2").collect()
    assert len(flat) == 280 and all(abs(r["dx"] - got[2]["dx"][r["y"] * 20 + r["x"]]) < 1e-12 for r in flat)
    assert fields.warp_fields(df.limit(0), 14, 20, 1.0).count() == 0


def test_frames_are_resampled_on_their_own_field(spark):
    r = np.random.default_rng(2)
    rows, own = point_rows(r)
    images = r.random((5, 14, 20))
    df = spark.createDataFrame([(i, 14, 20, a.ravel().tolist()) for i, a in enumerate(images)], "frame_id long, h int, w int, px array<double>")
    points = spark.createDataFrame(rows, "frame_id long, ax int, ay int, dx double, dy double, conf double")
    got = {x["frame_id"]: np.reshape(x["px"], (14, 20)) for x in fields.remap_frames(df, points, 1.5, F.col("frame_id") / 4.0, F.lit(-0.5)).collect()}
    y, x = np.mgrid[:14, :20].astype(float)
    for i, a in enumerate(images):
        dx, dy = plain_field(own[i], 14, 20, 1.5) if i in own else np.zeros((2, 14, 20))
        assert np.allclose(got[i], kernels.remap(a, x + i / 4 + dx, y - 0.5 + dy, "mirror"))
    assert len(got) == 5


def plain_patch(f, r, ax, ay, size):
    h, w = f.shape
    half = size // 2
    y0, y1, x0, x1 = max(0, ay - half), min(h, ay + half), max(0, ax - half), min(w, ax + half)
    dx, dy, _ = kernels.ncc_shift(r[y0:y1, x0:x1], f[None, y0:y1, x0:x1])[0]
    dx, dy = (0.0, 0.0) if max(abs(dx), abs(dy)) > half else (dx, dy)
    out = {}
    for y in range(max(0, ay - size), min(h, ay + size)):
        for x in range(max(0, ax - size), min(w, ax + size)):
            fx, fy = min(max(x + dx, 0), w - 1), min(max(y + dy, 0), h - 1)
            ix, iy = min(int(fx), w - 2), min(int(fy), h - 2)
            tx, ty = fx - ix, fy - iy
            out[y, x] = (1 - ty) * ((1 - tx) * f[iy, ix] + tx * f[iy, ix + 1]) + ty * ((1 - tx) * f[iy + 1, ix] + tx * f[iy + 1, ix + 1])
    return out


def plain_stack(images, files, picks, refs, size, base=None):
    out = {}
    for file, ref in refs.items():
        sigma = 2 * size / 3 if base is None else size / 4
        top, bottom = (np.zeros(ref.shape), np.zeros(ref.shape)) if base is None else (1e-3 * base[file], np.full(ref.shape, 1e-3))
        for ap in {p[2] for p in picks if p[0] == file}:
            sums, weight = {}, 0.0
            for p in picks:
                if p[0] == file and p[2] == ap and files[p[1]] == file:
                    ax, ay = p[3], p[4]
                    weight += p[5]
                    for k, v in plain_patch(images[p[1]], ref, ax, ay, size).items():
                        sums[k] = sums.get(k, 0) + p[5] * v
            for (y, x), v in sums.items():
                g = np.exp(-((x - ax) ** 2 + (y - ay) ** 2) / (2 * sigma**2))
                top[y, x] += g * v / weight
                bottom[y, x] += g
        out[file] = np.clip(np.where(bottom > 0, top / np.where(bottom > 0, bottom, 1), 0), 0, 1)
    return out


@pytest.mark.parametrize("held", [4_000_000, 100])
@pytest.mark.parametrize("with_base", [False, True])
def test_patch_stacks_equal_sums_by_pixel(spark, monkeypatch, held, with_base):
    monkeypatch.setattr(fields, "HELD", held)
    r = np.random.default_rng(7)
    y, x = np.mgrid[:24, :30]
    images = [np.clip(0.5 + 0.4 * np.sin((x + r.integers(-1, 2)) / 3) * np.cos((y + r.integers(-1, 2)) / 4) + 0.02 * r.random((24, 30)), 0, 1) for _ in range(9)]
    files = [i % 3 for i in range(9)]
    refs = {f: images[f] for f in range(3)}
    points = [(0, 6, 6), (1, 14, 12), (2, 28, 22), (3, 1, 2)]
    picks = [(files[i], i, ap, ax, ay, float(r.random()) + 0.1) for i in range(9) for ap, ax, ay in points if (i + ap) % 4]
    base = {f: r.random((24, 30)) for f in range(3)} if with_base else None
    df = spark.createDataFrame([(i, files[i], *a.shape, a.ravel().tolist()) for i, a in enumerate(images)], "frame_id long, file_id int, h int, w int, px array<double>").repartition(4)
    frames_of = lambda held_: spark.createDataFrame([(f, *a.shape, a.ravel().tolist()) for f, a in held_.items()], "file_id int, h int, w int, px array<double>")
    picked = spark.createDataFrame(picks, "file_id int, frame_id long, ap_id int, ax int, ay int, weight double")
    got = {x["file_id"]: np.reshape(x["px"], (24, 30)) for x in fields.patch_stack(df, picked, frames_of(refs), 6, base=frames_of(base) if with_base else None).collect()}
    want = plain_stack(images, files, picks, refs, 6, base)
    assert set(got) == set(want) and all(np.allclose(got[f], want[f], atol=1e-12) for f in want)
    sums = fields.patch_sums(df, picked, frames_of(refs), 6, "file_id")
    assert sums.count() == len({(p[0], p[2]) for p in picks})


def test_groups_without_picks_are_black_and_odd_frames_are_left_out(spark):
    df = spark.createDataFrame([(0, 1, 4, 4, [0.5] * 16), (1, 1, 4, 4, None), (2, 1, 2, 8, [0.5] * 16), (3, 2, 4, 4, [0.5] * 16)], "frame_id long, file_id int, h int, w int, px array<double>")
    picks = spark.createDataFrame([(1, i, 0, 2, 2, 1.0) for i in range(3)], "file_id int, frame_id long, ap_id int, ax int, ay int, weight double")
    refs = df.where("frame_id IN (0, 3)").select("file_id", "h", "w", "px")
    got = {r["file_id"]: r["px"] for r in fields.patch_stack(df, picks, refs, 2).collect()}
    assert np.allclose(got[1], 0.5) and got[2] == [0.0] * 16
    assert fields.patch_stack(df.limit(0), picks, refs.limit(0), 2).count() == 0
