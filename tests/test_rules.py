"""De-rotation, spectra, selection and order against plain NumPy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.operators import alignment, catalog, derotate, kernels, series, stack, windows
from lumastack.operators import frames as fr
from tests.test_operators import disk, frame_rows


def texture(cx=32.0, cy=32.0, seed=0):
    y, x = np.mgrid[:64, :64]
    return np.where(disk(cx=cx, cy=cy, a=20.0, b=18.0) > 0.5, 0.6 + 0.2 * np.sin((x - cx) / 3.0 + seed) * np.cos((y - cy) / 4.0), 0.02)


def plain_derotated(frame, delta, disk_, ratio, pole, scale):
    """Pixel by pixel, by the formulas of a tilted oblate disk."""
    h, w = frame.shape
    cx, cy, radius = disk_
    p = math.radians(pole)
    at = lambda y, x: frame[y, x] if 0 <= y < h and 0 <= x < w else 0.0
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            rx, ry = x - cx, y - cy
            eq, pol = rx * math.cos(p) + ry * math.sin(p), -rx * math.sin(p) + ry * math.cos(p)
            drift = scale * math.radians(delta) * math.sqrt(max(0.0, (1.05 * radius) ** 2 - eq * eq - (pol / ratio) ** 2))
            sx, sy = x - drift * math.cos(p), y - drift * math.sin(p)
            ix, iy = math.floor(sx), math.floor(sy)
            cubic = sum(float(kernels.cubic(np.array(sx - i))) * float(kernels.cubic(np.array(sy - j))) * at(j, i) for j in range(iy - 1, iy + 3) for i in range(ix - 1, ix + 3))
            linear = sum(max(0.0, 1 - abs(sx - i)) * max(0.0, 1 - abs(sy - j)) * at(j, i) for j in (iy, iy + 1) for i in (ix, ix + 1))
            inner = min(1.0, max(0.0, (radius - math.hypot(rx, ry)) / 12.0))
            out[y, x] = min(1.0, max(0.0, inner * cubic + (1 - inner) * linear))
    return out


def test_derotation_equals_plain_formulas():
    a = texture()
    got = derotate.derotated(a, 6.0, (31.5, 32.5, 20.0), 0.93, 25.0, 0.8)
    assert np.allclose(got, plain_derotated(a, 6.0, (31.5, 32.5, 20.0), 0.93, 25.0, 0.8), atol=1e-12)
    assert np.allclose(derotate.derotated(a, 0.0, (32, 32, 20.0), 0.9, 10.0, 0.8), a)


def timed(spark, images, times, scores, file=1):
    rows = [(file, i, a.shape[0], a.shape[1], a.ravel().tolist(), float(s), float(t)) for i, (a, t, s) in enumerate(zip(images, times, scores, strict=True))]
    df = spark.createDataFrame(rows, "file_id long, frame_id long, h int, w int, px array<double>, score double, t double")
    return df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).withColumn("center_s", F.lit(1000.0)).withColumn("pole", F.lit(15.0)).drop("t")


def test_derotate_stack_equals_plain_steps(spark):
    images = [texture(seed=0.0), texture(33.0, 32.0, 0.1) * 0.8, texture(32.0, 30.0, 0.2) * 0.9, texture() * 0.1]
    times, scores = [700.0, 1040.0, 1100.0, 990.0], [0.9, 0.8, 0.7, 0.1]
    stacked, log = derotate.derotate_stack(timed(spark, images, times, scores).repartition(3), ["file_id"], "center_s", "pole", 0.5)
    kept = [0, 1, 2]  # the fourth is under the threshold, though nearest to the centre
    e = fr.ellipses(images[1][None])
    own = (e["cx"][0], e["cy"][0], e["semi_major"][0])
    ratio = float(np.clip(e["semi_minor"][0] / e["semi_major"][0], 0.85, 1.0))
    turn = lambda i: derotate.derotated(images[i], (times[i] - 1000) / (9.9281 * 3600) * 360, own, ratio, 15.0, 0.8)
    goal = turn(1)
    box = lambda a: a[16:48, 16:48][a[16:48, 16:48] > 0.3 * a[16:48, 16:48].mean()]
    made, shifts = [], {}
    for i in kept:
        a = turn(i)
        if i != 1:
            a = np.clip(a * np.median(box(goal)) / np.median(box(a)), 0, 1)
            f = fr.ellipses(a[None])
            shifts[i] = (own[0] - f["cx"][0], own[1] - f["cy"][0])
            a = kernels.shift(a, *shifts[i])
        made.append(a)
    weights = np.array([scores[i] for i in kept])
    want = np.clip(np.tensordot(weights / weights.sum(), np.stack(made), 1), 0, 1)
    row = stacked.first()
    assert row["n"] == 3 and np.allclose(np.reshape(row["px"], (64, 64)), want, atol=1e-12)
    rows = {r["frame_id"]: r for r in log.collect()}
    assert set(rows) == {0, 1, 2} and rows[1]["align_method"] == "reference" and rows[1]["is_reference"] and rows[0]["align_method"] == "limb"
    assert np.allclose(rows[2]["align_shift_px"], np.round(shifts[2], 3), atol=1e-3) and rows[0]["dt_sec"] == -300.0


def test_group_under_the_threshold_keeps_all_and_one_frame_stays(spark):
    a = texture()
    stacked, log = derotate.derotate_stack(timed(spark, [a], [1000.0], [0.1]), ["file_id"], "center_s", None, 0.5)
    assert log.count() == 1 and np.allclose(np.reshape(stacked.first()["px"], (64, 64)), a)
    assert derotate.derotate_stack(timed(spark, [a], [1000.0], [0.1]).limit(0), ["file_id"], "center_s")[0].count() == 0


def test_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(derotate, "BLOCK", 7)
    r = np.random.default_rng(1)
    images, w = r.random((9, 5, 6)), r.random(9)
    df = frame_rows(spark, images).withColumn("k", F.col("frame_id") % 2).join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "frame_id long, score double"), "frame_id")
    for row in derotate.stacked_frames(df.repartition(4), ["k"]).collect():
        own = np.arange(9) % 2 == row["k"]
        assert np.allclose(row["px"], np.average(images[own], axis=0, weights=w[own]).ravel()) and row["n"] == own.sum()


@pytest.mark.parametrize("block", [10, 10_000])
def test_fourier_stack_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(fr, "FREQUENCIES", block)
    r = np.random.default_rng(2)
    images, q, noise = r.random((6, 8, 8)), r.random(6), r.random((3, 8, 8)) * 0.1
    df = frame_rows(spark, images).withColumn("filter", F.lit("R")).join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(q)], "frame_id long, q double"), "frame_id").repartition(3)
    floors = fr.spectra_floor(frame_rows(spark, noise).withColumn("filter", F.lit("R")), "filter")
    spectra = np.fft.fft2(images)
    mag = np.abs(spectra)
    floor = np.abs(np.fft.fft2(noise)).mean(0)
    assert np.allclose(floors.first()["floor"], floor.ravel())
    w = q[:, None, None] * np.maximum(mag - floor, 0) ** 1.5
    whole = (w * spectra).sum(0) / w.sum(0) * np.tanh(mag.mean(0) / (mag.std(0) + 1e-9) / 2.0)
    f = np.hypot(np.fft.fftfreq(8)[:, None], np.fft.fftfreq(8)[None, :])
    want = np.clip(np.fft.ifft2(whole * np.exp(-0.5 * (f / 0.2) ** 2)).real, 0, 1)
    got = fr.fourier_stack(df, "filter", 1.5, F.col("q"), floors, 2.0, 0.2).first()["px"]
    assert np.allclose(np.reshape(got, (8, 8)), want, atol=1e-9)


def test_patch_scores_equal_plain(spark):
    r = np.random.default_rng(3)
    images = [np.where(r.random((16, 16)) > 0.3, r.random((16, 16)), 0.01), np.full((16, 16), 0.0)]
    aps, half = [(4, 4), (8, 10)], 4
    got = {(x["frame_id"], x["ap_id"]): x["score"] for x in fr.log_ap_scores(frame_rows(spark, images), aps, 8, 1.2).collect()}
    sharp = {(x["frame_id"], x["ap_id"]): x["sharpness"] for x in fr.patch_sharpness(frame_rows(spark, images), aps, 8).collect()}
    for i, a in enumerate(images):
        for k, (x, y) in enumerate(aps):
            p = a[y - half : y + half, x - half : x + half]
            assert abs(sharp[i, k] - kernels.laplacian(p).var()) < 1e-12
            p = p / p.max() if p.max() > 1e-9 else p
            mask = p > 0.25
            want = kernels.laplacian(kernels.separable(p, kernels.gauss_taps(1.2)))[mask].var() if mask.sum() >= 5 else 0.0
            assert abs(got[i, k] - want) < 1e-12
    with pytest.raises(ValueError):
        fr.log_ap_scores(frame_rows(spark, images), [(1, 8)], 8)


def test_rejected_phase_shifts_are_null(spark):
    y, x = np.mgrid[:64, :64]
    blob = lambda dx: np.exp(-((x - 32 - dx) ** 2 + (y - 30) ** 2) / 60.0)
    got = {r["frame_id"]: r for r in fr.phase_qsf_shifts(frame_rows(spark, [blob(2.0), blob(12.0)]), blob(0).tolist(), 0.02, 5.0).collect()}
    assert abs(got[0]["dx"] - 2) < 0.5 and got[1]["dx"] is None and got[1]["conf"] == 0


def test_size_gate_waits_for_twenty_and_looks_back_over_a_hundred(spark):
    sizes = [50] * 40 + [40] * 30
    boxes = spark.createDataFrame([(1, i, s, s) for i, s in enumerate(sizes)], "file_id long, frame_idx long, bw int, bh int")
    assert [r["accepted"] for r in fr.size_gate(boxes).orderBy("frame_idx").collect()] == [True] * 40 + [False] * 30


def test_reference_file_order_and_forced_name(spark):
    files = spark.createDataFrame([("CH4", "a-CH4-1"), ("B", "b-B-1"), ("B", "c-B-2"), ("B", "d-B-3"), ("L", "e-other")], "filter string, name string")
    pick = lambda **k: [r["name"] for r in catalog.pick_reference_file(files, **k).collect()]
    assert pick() == ["c-B-2"] and pick(forced="ch4") == ["a-CH4-1"] and pick(forced="nothing") == ["c-B-2"]
    assert [r["name"] for r in catalog.pick_reference_file(files.where("filter = 'L'")).collect()] == ["e-other"]


def test_order_over_parts(spark):
    r = np.random.default_rng(4)
    values = np.unique(np.concatenate((r.random(300) * 100, 500 + r.random(50), [900.0])))
    df = spark.createDataFrame([(float(v),) for v in r.permutation(values)], "v double").repartition(7)
    got = [(x["v"], x["_place"], x["_island"]) for x in windows.in_order(df, "v", 5.0).orderBy("v").collect()]
    assert got == [(v, i + 1, int((np.diff(values)[:i] > 5.0).sum())) for i, v in enumerate(values.tolist())]
    rows = spark.createDataFrame([(None, 1), (None, 3), ("a", 2), ("a", 5)], "k string, v int")
    assert sorted((x["k"] or "", x["v"], x["rank"]) for x in windows.ranked(rows, ["k"], F.desc("v")).collect()) == [("", 1, 2), ("", 3, 1), ("a", 2, 2), ("a", 5, 1)]


def test_islands_and_bins_have_no_window_over_all(spark):
    rows = spark.createDataFrame([(i, 1800.0 * i + (40_000 if i > 5 else 0)) for i in range(12)], "cycle_id long, center_s double")
    made = series.cycle_islands(rows, 30.0)
    assert [(r["position"], r["island"]) for r in made.orderBy("position").collect()] == [(i + 1, int(i > 5)) for i in range(12)]
    assert "Exchange SinglePartition" not in stack.select_top(rows.withColumn("k", F.lit(1)), "k", 0.5, 1, "center_s", "cycle_id")._jdf.queryExecution().toString()


def test_rolloff_and_blend_of_patches(spark):
    r = np.random.default_rng(5)
    a = r.random((2, 16, 16))
    f = np.hypot(np.fft.fftfreq(16)[:, None], np.fft.fftfreq(16)[None, :])
    assert np.allclose(kernels.rolled_off(a, 0.2), np.clip(np.fft.ifft2(np.fft.fft2(a) * np.exp(-0.5 * (f / 0.2) ** 2)).real, 0, 1))
    df = frame_rows(spark, a[:1]).withColumn("file_id", F.lit(1))
    picks = spark.createDataFrame([(1, 0, 0, 8, 8, 1.0)], "file_id int, frame_id long, ap_id int, ax int, ay int, weight double")
    base = spark.createDataFrame([(1, y, x, 0.5) for y in range(16) for x in range(16)], "file_id int, y int, x int, v double")
    got = {(p["y"], p["x"]): p["v"] for p in alignment.per_ap_patch_stack(df, picks, df.select("file_id", "h", "w", "px"), 4, base=base).collect()}
    y, x = np.mgrid[:16, :16]
    g = np.where((np.abs(y - 7.5) < 4) & (np.abs(x - 7.5) < 4), np.exp(-((x - 8) ** 2 + (y - 8) ** 2) / 2.0), 0)
    assert np.allclose([got[int(j), int(i)] for j, i in zip(y.ravel(), x.ravel(), strict=True)], ((g * a[0] + 0.5e-3) / (g + 1e-3)).ravel())
