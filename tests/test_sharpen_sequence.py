"""Sharpening at the limb, tapers and the series job against plain loops."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from lumastack.operators import kernels, sequence, sharpen
from lumastack.operators import frames as fr

T0 = datetime.datetime(2024, 1, 1)


def disk(h=48, w=48, cx=24.0, cy=23.0, a=15.0, b=12.0, soft=1.0):
    y, x = np.mgrid[:h, :w]
    d = (1 - np.hypot((x - cx) / a, (y - cy) / b)) * math.sqrt(a * b) / soft
    return np.clip(d, 0, 1) * (0.7 + 0.1 * np.sin(x / 2.0)) + 0.02


def disks_of(*rows):
    return {k: np.array([r[i] for r in rows], float) for i, k in enumerate(("cx", "cy", "semi_major", "semi_minor", "angle"))}


def test_blob_details():
    bell, bend = sharpen.blob_taps(1.5)
    assert len(bell) == len(bend) == 11 and abs(bell.sum() - 1) < 1e-12 and abs((bend**2).sum() - 1) < 1e-12
    a = np.random.default_rng(1).random((2, 12, 10))
    parts = sharpen.log_decompose(a, 3)
    assert len(parts) == 4 and np.allclose(sum(parts), a)
    assert np.allclose(sum(sharpen.bilateral_decompose(a, 2)), a)
    flat = np.full((1, 9, 9), 0.4)
    assert np.allclose(sharpen.bilateral_decompose(flat, 2)[0], 0)


def test_disk_sharpen_equals_loops():
    rng = np.random.default_rng(2)
    a = np.stack([disk(), disk(cx=20, a=14, b=13)]) + 0.02 * rng.random((2, 48, 48))
    found = disks_of((24, 23, 15, 12, 20.0), (20, 23, 14, 13, 0.0))
    amounts, denoise, gate, feather, expand = [100.0, 50.0], (0.2,), 0.1, 1.5, 2.0
    got = sharpen.disk_sharpen(a, found, amounts, denoise=denoise, gate=gate, feather=feather, expand=expand)
    for i in range(2):
        cx, cy, rx, ry, tilt = (found[k][i] for k in ("cx", "cy", "semi_major", "semi_minor", "angle"))
        rx, ry, t = rx + expand, ry + expand, math.radians(tilt)
        far = np.array([[math.sqrt((((x - cx) * math.cos(t) + (y - cy) * math.sin(t)) / rx) ** 2 + ((-(x - cx) * math.sin(t) + (y - cy) * math.cos(t)) / ry) ** 2) for x in range(48)] for y in range(48)])
        want = a[i].copy()
        for level, gain in enumerate((0.5 * 29.15, 0.25 * 9.48)):
            d = kernels.atrous(a[i : i + 1], 2)[level][0]
            for part in ((0.2, 0.1) if level == 0 else (0.1,)):
                cut = part * np.median(np.abs(d[far <= 1])) / 0.6745
                d = np.sign(d) * np.maximum(np.abs(d) - cut, 0)
            for y in range(48):
                for x in range(48):
                    s = min(1.0, max(0.0, (1 - far[y, x]) * math.sqrt(rx * ry) / max(1.0, 2**level * feather)))
                    want[y, x] += gain * d[y, x] * 0.5 * (1 - math.cos(math.pi * s))
        assert np.allclose(got[i], np.clip(want, 0, 1))
        assert np.allclose(got[i][far > 1], np.clip(a[i], 0, 1)[far > 1])


def test_noise_without_enough_disk():
    a = np.random.default_rng(3).random((1, 16, 16))
    tiny = disks_of((8, 8, 1, 1, 0.0))
    out = sharpen.disk_sharpen(a, tiny, [100.0], gate=0.5)
    assert np.isfinite(out).all() and np.allclose(out[0, 0], a[0, 0])


def test_tapers():
    a = np.zeros((3, 40, 50))
    a[0, 12:30, 9:47] = 0.8
    a[2] = 0.7
    assert sharpen.safe_taper_widths(a, 6).tolist() == [[6, 5, 4, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    ones, widths = np.ones((1, 10, 12)), np.array([[3, 0, 2, 4]])
    got = sharpen.tapered(ones, widths)[0]
    for y in range(10):
        for x in range(12):
            ramps = [0.5 * (1 - math.cos(math.pi * p / n)) for p, n in ((y, 3), (x, 2), (11 - x, 4)) if p < n]
            assert abs(got[y, x] - min([1.0, *ramps])) < 1e-12


def test_limb_params():
    sharp, soft = disk(200, 200, 100, 100, 60, 55, soft=1.0), disk(200, 200, 100, 100, 60, 55, soft=10.0)
    feather, expand = sharpen.limb_params(np.stack([sharp, soft, np.zeros((200, 200)), np.full((200, 200), 0.5)]), disks_of(*[(100, 100, 60, 55, 0.0)] * 4))
    assert expand.tolist() == [round(0.0505 * math.sqrt(60 * 55), 1)] * 2 + [5.0, 5.0]
    assert 1 <= feather[0] < feather[1] <= 8 and feather[2:].tolist() == [3.0, 3.0]


def frame_table(spark, rows):
    return spark.createDataFrame([(i, f, T0 + datetime.timedelta(seconds=s), score, a.shape[0], a.shape[1], a.ravel().tolist()) for i, f, s, score, a in rows], "frame_id long, filter string, ts timestamp_ntz, score double, h int, w int, px array<double>")


def test_sharpened_job(spark):
    small = np.zeros((48, 48))
    small[20:23, 20:23] = 0.5
    rows = frame_table(spark, [(1, "R", 0, 1.0, disk()), (2, "R", 1, 1.0, small)])
    got = {r["frame_id"]: np.array(r["px"]).reshape(48, 48) for r in sharpen.sharpened(rows, [100.0, 50.0], taper=3).collect()}
    a = sharpen.tapered(disk()[None], sharpen.safe_taper_widths(disk()[None], 3))
    feather, expand = sharpen.limb_params(a, fr.ellipses(a))
    assert np.allclose(got[1], sharpen.disk_sharpen(a, fr.ellipses(a), [100.0, 50.0], feather=feather, expand=expand)[0])
    b = sharpen.tapered(small[None], sharpen.safe_taper_widths(small[None], 3))
    assert np.allclose(got[2], kernels.sharpen(b, [100.0, 50.0])[0])  # its disk is too small


def test_members_stop_at_gaps(spark):
    times = [0, 300, 600, 3000, 3300]
    rows = spark.createDataFrame([(str(i), T0 + datetime.timedelta(seconds=s + d), f) for i, (s, d, f) in enumerate((s, d, f) for s in times for d, f in ((10, "R"), (20, "G")))], "stem string, ts timestamp_ntz, filter string")
    scores = spark.createDataFrame([("0", 0.1), ("2", 0.5)], "stem string, score double")
    got = sequence.members(rows, 5, 3, None, scores, 0.3).toPandas()
    near = {c: sorted(set(g["near_id"])) for c, g in got.groupby("cycle_id")}
    assert near == {0: [0, 1], 1: [0, 1, 2], 2: [1, 2], 10: [10, 11], 11: [10, 11]}
    first = got[(got["cycle_id"] == 1) & (got["filter"] == "R")].set_index("stem")
    assert np.allclose(first["weight"].loc[["0", "2", "4"]], np.array([0.05, 0.25, 1.0]) / 1.3)  # no score counts as 1
    assert first["n_below"].tolist() == [1, 1, 1] and first["middle"].loc["2"] and first["middle"].sum() == 1
    assert np.allclose(first["dt_sec"].loc[["0", "2", "4"]], [-305, -5, 295])
    log = {(r["cycle_id"], r["filter"]): r for r in sequence.frame_log(sequence.members(rows, 5, 3, None, scores, 0.3)).collect()}[(1, "R")]
    assert (log["n_used"], log["n_below"], log["scores"]) == (3, 1, [0.1, 0.5, 1.0])
    assert abs(log["avg_dt_sec"] - round((0.05 * -305 + 0.25 * -5 + 295) / 1.3, 1)) < 1e-9


def test_normalised_equals_numpy(spark):
    rng = np.random.default_rng(5)
    held = [(c, f, 6, 7, (rng.random((6, 7)) * (0.3 + 0.1 * c)).ravel().tolist()) for c in range(3) for f in ("R", "G", "IR")]
    held.append((3, "IR", 6, 7, [0.5] * 42))
    got = {(r["cycle_id"], r["filter"]): np.array(r["px"]) for r in sequence.normalised(spark.createDataFrame(held, "cycle_id long, filter string, h int, w int, px array<double>"), "cycle_id").collect()}
    for names in (("R", "G"), ("IR",)):
        whole = np.concatenate([p for _, f, _, _, p in held if f in names])
        for c, f, _, _, p in held:
            if f in names:
                p = np.array(p)
                assert np.allclose(got[c, f], np.clip((p - p.mean()) / max(p.std(), 1e-7) * whole.std() + whole.mean(), 0, 1))


def test_series_brings_members_together(spark):
    """A disk that stands still is left where it is; the stack of a cycle equals its only frame where n is 1 and its time is the middle."""
    rows, i = [], 0
    for c in range(3):
        for f in ("R", "G", "B"):
            rows.append((i, f, 300 * c + 150, 0.8, disk()))
            i += 1
    table = frame_table(spark, rows)
    made, log = sequence.series_frames(table, 5, 3, scale=0.0, period_hours=1e9)
    px = made.where((F.col("cycle_id") == 1) & (F.col("name") == "RGB")).toPandas().sort_values(["y", "x"])
    want = kernels.shift(disk(), 24 - fr.ellipses(disk()[None])["cx"][0], 24 - fr.ellipses(disk()[None])["cy"][0])
    assert len(px) == 48 * 48 and np.abs(px["G"].to_numpy().reshape(48, 48) - 0.8 * want)[3:-3, 3:-3].max() < 1e-3
    assert {r["n_used"] for r in log.where("cycle_id = 1").collect()} == {3} and log.count() == 9
    empty, none = sequence.series_frames(table.where("false"), 5, 3)
    assert empty.count() == 0 and none.count() == 0


def test_limbs_of_many_frames_take_no_more_memory():
    import tracemalloc

    a = np.random.default_rng(2).random((3000, 8, 8))
    disks = {k: np.full(len(a), v) for k, v in (("cx", 4.0), ("cy", 4.0), ("semi_major", 3.0), ("semi_minor", 2.5), ("angle", 10.0))}
    tracemalloc.start()
    made = sharpen.limb_params(a, disks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and all(len(m) == 3000 for m in made)
    for m, one in zip(made, sharpen.limbs(a[:700], {k: v[:700] for k, v in disks.items()}), strict=True):
        assert (m[:700] == one).all()
