"""Kernels and operators against small cases with known answers."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumastack.functions.sql import register_functions
from lumastack.operators import catalog, composite, kernels, series, stack, windows
from lumastack.operators import frames as fr


def disk(h=64, w=64, cx=32.0, cy=32.0, a=15.0, b=12.0):
    y, x = np.mgrid[:h, :w]
    return np.where(((x - cx) / a) ** 2 + ((y - cy) / b) ** 2 <= 1, 0.8, 0.05)


def frame_rows(spark, images, **more):
    rows = [(i, a.shape[0], a.shape[1], a.ravel().tolist()) for i, a in enumerate(images)]
    return spark.createDataFrame(rows, "frame_id long, h int, w int, px array<double>")


@given(st.integers(1, 4), st.integers(0, 2**32 - 1))
@settings(max_examples=20, deadline=None)
def test_details_sum_to_frame(levels, seed):
    a = np.random.default_rng(seed).random((2, 9, 11))
    assert np.allclose(sum(kernels.atrous(a, levels)), a)


def test_shift_is_recovered():
    y, x = np.mgrid[:64, :64]
    blob = lambda dx, dy: np.exp(-((x - 32 - dx) ** 2 + (y - 30 - dy) ** 2) / 60.0)
    for find in (kernels.phase_shift, kernels.ncc_shift):
        dx, dy, conf = find(blob(0, 0), blob(3.0, -2.0)[None])[0]
        assert abs(dx - 3) < 0.5 and abs(dy + 2) < 0.5 and conf > 0.05
    assert np.allclose(kernels.shift(blob(0, 0), 3, -2)[10:50, 10:50], blob(3, -2)[10:50, 10:50], atol=1e-6)


def test_components_thresholds_ellipse(spark):
    two = disk() + 0.0
    two[2:6, 2:6] = 0.9
    flat = np.full((64, 64), 0.5)
    found = {r["frame_id"]: r for r in fr.components(frame_rows(spark, [disk(), two, flat])).collect()}
    assert 31 <= found[0]["bw"] <= 35 and 25 <= found[0]["bh"] <= 29  # the blur adds up to two pixels to each side
    assert found[1]["bx"] > 10
    assert found[2]["bx"] is None or found[2]["area"] > 0
    e = {r["frame_id"]: r for r in fr.disk_ellipse(frame_rows(spark, [disk(cx=30, cy=33)])).collect()}[0]
    assert abs(e["cx"] - 30) < 0.5 and abs(e["cy"] - 33) < 0.5
    assert 0 <= 15 - e["semi_major"] < 1 and 0 <= 12 - e["semi_minor"] < 1  # the ellipse runs through the outermost pixels' centres, inside the disk's edge


def test_screen_reasons(spark):
    rows = [(0, 64, 64, 10, 10, 20, 20, 0.5), (1, 64, 64, 0, 10, 20, 20, 0.5), (2, 64, 64, 10, 10, 30, 10, 0.5), (3, 64, 64, 10, 10, 20, 20, 0.95), (4, 64, 64, 10, 10, 2, 2, 0.5), (5, 64, 64, None, None, None, None, None)]
    boxes = spark.createDataFrame(rows, "frame_id long, h int, w int, bx int, by int, bw int, bh int, edge double")
    got = {r["frame_id"]: r["reject"] for r in fr.screen_shape(boxes).collect()}
    assert got == {0: None, 1: "border", 2: "aspect", 3: "edge", 4: "small", 5: "none"}


def test_size_gate_ignores_rejected(spark):
    sizes = [50] * 24 + [30] * 10 + [48] * 6
    rows = [(1, i, s, s) for i, s in enumerate(sizes)]
    boxes = spark.createDataFrame(rows, "file_id long, frame_idx long, bw int, bh int")
    got = [r["accepted"] for r in fr.size_gate(boxes).orderBy("frame_idx").collect()]
    assert got == [True] * 24 + [False] * 10 + [True] * 6


@pytest.mark.parametrize(("depth", "trailer"), [(8, True), (16, False)])
def test_ser_source(spark, tmp_path, depth, trailer):
    from lumastack.sources.ser import SerSource

    n, h, w = 6, 4, 5
    px = np.random.default_rng(1).integers(0, 2**depth, (n, h, w)).astype("u1" if depth == 8 else "<u2")
    head = b"LUCAM-RECORDER" + struct.pack("<7I", 0, 8, 0, w, h, depth, n) + b"\0" * 136
    ticks = struct.pack(f"<{n}Q", *range(100, 100 + n)) if trailer else b""
    (tmp_path / "a.ser").write_bytes(head + px.tobytes() + ticks)
    spark.dataSource.register(SerSource)
    rows = spark.read.format("ser").option("path", str(tmp_path)).load().orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in rows] == list(range(n))
    assert np.array_equal(np.array([r["px"] for r in rows]).reshape(n, h, w), px)
    assert [r["ts_ticks"] for r in rows] == (list(range(100, 106)) if trailer else [None] * n)
    assert rows[0]["color_id"] == 8


def test_file_names(spark):
    paths = ["/x/2026-03-20-1046_1-U-IR-Jup_pipp_lapl3_ap51.tif", "/x/Jupiter_20231025-213045_lapl6_ap47.tif", "/d/2023-10-25/Jupiter/21_50_23_lapl6_ap47_conv.tif", "/x/notes.tif", "/x/Mars_20231025-993045.tif"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = [r["m"] for r in df.select(catalog.parse_capture_name(F.col("path")).alias("m")).collect()]
    assert str(rows[0]["ts"]) == "2026-03-20 10:46:06" and rows[0]["filter"] == "IR" and rows[0]["target"] == "Jup"
    assert str(rows[1]["ts"]) == "2023-10-25 21:30:48" and rows[1]["filter"] is None and rows[1]["target"] == "Jup"
    assert str(rows[2]["ts"]) == "2023-10-25 21:50:24" and rows[2]["target"] == "Jup"
    assert rows[3] is None and rows[4] is None
    stems = [r["s"] for r in df.select(catalog.canonical_stem(F.col("path"), F.lit("R"), F.lit("Jup")).alias("s")).collect()]
    assert stems[1] == "2023-10-25-2130_8-U-R-Jup" and stems[2] == "2023-10-25-2150_4-U-R-Jup" and stems[3] == "notes"


def test_folder_metadata_covers_every_path(spark, sf):
    from lumastack.plans import registry

    rows = [("/d/2023-10-25/Mars/a.tif",), ("/d/Saturn/2023-10-25/a.tif",), ("/d/x/a.tif",), ("a.tif",)]
    day = F.lit("2024-02-03 04:05:06").cast("timestamp_ntz")
    found = spark.createDataFrame(rows, "path string").select(catalog.folder_date(F.col("path"), day), catalog.folder_target(F.col("path"))).collect()
    assert [tuple(r) for r in found] == [("2023-10-25", "Mar"), ("2023-10-25", "Sat"), ("2024-02-03", None), ("2024-02-03", None)]
    events = spark.read.parquet(f"{sf}/events.parquet")
    every = registry.QUERIES["folder_metadata_all"](spark, sf)
    assert every.select("event_id").exceptAll(events.select("event_id")).isEmpty() and every.count() == events.count()


def captures(spark, rows):
    return spark.createDataFrame(rows, "stem string, ts string, filter string, raw_score double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_window_ends_are_inside_and_incomplete_windows_go(spark):
    c = captures(spark, [("a", "2024-01-01 00:30:00", "IR", 1.0), ("b", "2024-01-01 00:00:00", "R", 1.0), ("c", "2024-01-01 01:00:00", "R", 2.0), ("d", "2024-01-01 01:00:01", "R", 3.0), ("e", "2024-01-01 05:00:00", "IR", 2.0)])
    members = windows.anchor_windows(windows.norm_scores(c), 60.0)
    assert sorted(r["stem"] for r in members.where("window_id = 'a'").collect()) == ["a", "b", "c"]
    found = windows.search(c, ["IR", "R"], 60.0, 15.0).collect()
    assert [r["window_id"] for r in found] == ["a"]
    assert found[0]["window_quality"] == 0.0


def test_gap_of_two_cycles_stays_and_more_cuts(spark):
    rows = spark.createDataFrame([(0, 0.0), (2, 3600.0), (5, 7201.0)], "cycle_id long, center_s double")
    assert [r["island"] for r in series.cycle_islands(rows, 30.0).orderBy("cycle_id").collect()] == [0, 0, 1]


def test_stack_of_equal_frames_is_the_frame(spark):
    px = spark.createDataFrame([(f, y, x, 0.1 * y + 0.01 * x, 0.5 + f) for f in range(3) for y in range(3) for x in range(3)], "frame_id long, y int, x int, v double, s double")
    for made in (stack.weighted_stack(px, [], F.col("s")), stack.sigma_clip_stack(px, []), stack.mean_stack(px, [])):
        assert all(abs(r["v"] - (0.1 * r["y"] + 0.01 * r["x"])) < 1e-9 for r in made.collect())


def test_sigma_clip_drops_outlier(spark):
    px = spark.createDataFrame([(f, 0, 0, 0.9 if f == 0 else 0.2) for f in range(20)], "frame_id long, y int, x int, v double")
    row = stack.sigma_clip_stack(px, []).first()
    assert abs(row["v"] - 0.2) < 1e-9 and abs(row["clipped"] - 0.05) < 1e-9


def test_fourier_stack_of_equal_frames(spark):
    a = disk(16, 16, 8, 8, 4, 4)
    df = frame_rows(spark, [a, a, a]).withColumn("filter", F.lit("R"))
    px = np.array(fr.fourier_stack(df).first()["px"]).reshape(16, 16)
    assert np.allclose(px, a, atol=1e-9)


def test_lab_round_trip(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.9), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)], "r double, g double, b double")
    lab = composite.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    back = df.select("*", lab.alias("lab")).select("*", composite.lab_to_rgb(F.col("lab.l"), F.col("lab.a"), F.col("lab.b")).alias("q"))
    for row in back.collect():
        assert all(abs(row[k] - row["q"][k]) < 1e-3 for k in "rgb")


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT raw_score(1D, 2D, 3D) AS a, soft_threshold(-0.5D, 0.2D) AS b, trusted_shift(0.5D, 3D, 4D) AS c, levels_adjust(0.5D, 0D, 1D, 2D) AS d").first()
    assert abs(row["a"] - 1.7) < 1e-12 and abs(row["b"] + 0.3) < 1e-12 and row["c"] and abs(row["d"] - 0.5**0.5) < 1e-12


def test_stream_islands_equal_batch(spark, tmp_path):
    from lumastack.streaming.streams import islands, run_to_end, size_gate_stream

    rows = captures(spark, [(str(i), f"2024-01-01 {h:02d}:00:00", "R", 1.0) for i, h in enumerate((0, 1, 4, 5, 9))]).select("ts", "filter")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    want = sorted(map(tuple, islands(rows, 30.0).collect()))
    assert sorted(map(tuple, run_to_end(islands(stream, 30.0), "complete").collect())) == want and len(want) == 3
    sizes = spark.createDataFrame([(1, i, 50 if i < 24 else 20) for i in range(30)], "file_id long, frame_idx long, bw int").withColumn("bh", F.col("bw"))
    sizes.coalesce(1).write.parquet(str(tmp_path / "s"))
    flags = run_to_end(size_gate_stream(spark.readStream.schema(sizes.schema).parquet(str(tmp_path / "s"))), "append").orderBy("frame_idx").collect()
    assert [r["accepted"] for r in flags] == [True] * 24 + [False] * 6


@pytest.mark.parametrize("parts", [None, 3])
def test_stream_reads_the_whole_table_and_no_other(spark, sf, tmp_path, parts):
    import shutil

    import pyarrow.parquet as pq

    from lumastack.plans import registry

    if parts:
        spark.read.parquet(f"{sf}/events.parquet").repartition(parts).write.parquet(str(tmp_path / "events.parquet"))
    else:
        shutil.copy(f"{sf}/events.parquet", tmp_path / "events.parquet")
    pq.write_table(pq.read_table(f"{sf}/events.parquet").slice(0, 10), tmp_path / "events_old.parquet")
    for name in ("stream_capture_counts", "stream_cycle_counts"):
        got, want = (registry.QUERIES[name](spark, at).collect() for at in (str(tmp_path), sf))
        assert sum(r["n"] for r in want) == 1000 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_results_are_files(spark, tmp_path):
    from lumastack.streaming.streams import capture_counts, run_to_end

    rows = spark.createDataFrame([(i % 7, "R") for i in range(70)], "session long, filter string")
    rows.repartition(3).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    counts, every = run_to_end(capture_counts(stream), "complete"), run_to_end(stream, "append")
    assert sorted(map(tuple, counts.collect())) == [(i, "R", 10) for i in range(7)]
    assert sorted(every.collect()) == sorted(rows.collect())
    assert counts.inputFiles() and every.inputFiles()
    (tmp_path / "none").mkdir()
    assert run_to_end(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "none")), "append").count() == 0


def plain_layers(f, size, part, cx, cy, radius):
    """Layer by layer, each candidate against all before it."""
    h, w = f.shape
    out = []
    for s in (size, round(size * 1.5 / 8) * 8, size * 3):
        half, own = s // 2, []
        for y in range(half, h - half):
            for x in range(half, w - half):
                bright = f[y - half : y + half, x - half : x + half].sum() / (s * s) >= part * f.max()
                if (x - cx) ** 2 + (y - cy) ** 2 < radius**2 and bright and all((x - a) ** 2 + (y - b) ** 2 >= round(s * 35 / 64) ** 2 for a, b in own):
                    own.append((x, y))
        out += [(x, y, s) for x, y in own]
    return out


def test_poisson_grid_has_three_layers_in_the_disk(spark):
    dim = disk(a=20.0, b=20.0) * 0.4
    dim[2:14, 2:14] = 0.3
    got = [(r["ax"], r["ay"], r["size"]) for r in fr.poisson_grid(frame_rows(spark, [dim]), 8, 0.5).orderBy("ap_id").collect()]
    e = fr.ellipses(dim[None])
    assert got == plain_layers(dim, 8, 0.5, e["cx"][0], e["cy"][0], e["semi_major"][0])
    assert {s for _, _, s in got} == {8, 16, 24} and all((x - 32) ** 2 + (y - 32) ** 2 < 21**2 for x, y, _ in got)


def test_balance_is_that_of_the_disk_and_shifts_are_found(spark):
    from lumastack.operators import alignment

    y, x = np.mgrid[:64, :64]
    texture = 0.2 * np.sin(x / 2.0) * np.cos(y / 3.0)
    g = disk(a=15.0, b=15.0) + np.where(disk(a=15.0, b=15.0) > 0.5, texture, 0)
    r = np.roll(g, 2, axis=1) * 0.5
    r[:20] += 0.04
    rows = [("f", int(i), int(j), float(r[i, j]), float(g[i, j]), float(g[i, j] * 0.8)) for i in range(64) for j in range(64)]
    df = spark.createDataFrame(rows, "k string, y int, x int, R double, G double, B double")
    got = alignment.disk_balance(df, ["k"]).first()
    assert abs(got["gain_r"] - 2) < 0.1 and abs(got["gain_b"] - 1.25) < 1e-6
    assert abs(got["dx_r"] - 2) < 0.5 and abs(got["dy_r"]) < 0.5 and abs(got["dx_b"]) < 0.1


def plan(df):
    return df._jdf.queryExecution().toString()


def test_joint_percentiles_come_from_ranks(spark):
    r = np.random.default_rng(5)
    values = {"a": r.random(501), "b": np.repeat([0.1, 0.4, 0.9], [300, 1, 99]), "c": np.array([0.3])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double").repartition(5)
    for row in windows.percentiles(df, "k", "v", lo=0.01, mid=0.5, hi=0.999).collect():
        assert np.allclose([row["lo"], row["mid"], row["hi"]], np.quantile(values[row["k"]], [0.01, 0.5, 0.999]), atol=1e-12)
    made = composite.stretched(df, ["k"], 0.01, 0.99, joint=True)
    assert "percentile(" not in plan(made) and made.count() == sum(map(len, values.values())) + 1


def test_size_gate_holds_no_file(spark):
    r = np.random.default_rng(6)
    rows = [(f, i, int(r.integers(30, 60)), int(r.integers(30, 60))) for f in (1, 2, None) for i in range(60)]
    want = {}
    for f in (1, 2, None):
        ws, hs = [], []
        for _, i, w, h in (x for x in rows if x[0] == f):
            ok = len(ws) < 20 or (w >= np.median(ws[-20:]) * 0.8 and h >= np.median(hs[-20:]) * 0.8)
            ws, hs = (ws + [w], hs + [h]) if ok else (ws, hs)
            want[f, i] = ok
    made = fr.size_gate(spark.createDataFrame(rows, "file_id long, frame_idx long, bw int, bh int").repartition(5), window=20, tolerance=0.2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {(x["file_id"], x["frame_idx"]): x["accepted"] for x in made.collect()} == want and not all(want.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in plan(made)


def test_gaps_are_filled_over_parts_in_one_step_a_row(spark):
    from lumastack.operators.frames import interpolated

    known = [i % 7 == 3 and i != 38 for i in range(60)]
    rows = [("a", i, float(i * i % 11) if known[i] else None) for i in range(60)] + [("b", 1, None), ("b", 2, None), (None, 5, 2.0), (None, 7, None)]
    made = interpolated(spark.createDataFrame(rows, "g string, i long, s double").repartition(3), "g", "i", "s")
    assert "unboundedfollowing" not in made._jdf.queryExecution().analyzed().toString()
    x = [i for i in range(60) if known[i]]
    want = dict(zip(range(60), np.interp(range(60), x, [i * i % 11 for i in x]), strict=True))
    got = {(r["g"], r["i"]): r["filled"] for r in made.collect()}
    assert len(got) == 64 and all(abs(got["a", i] - v) < 1e-9 for i, v in want.items())
    assert got["b", 1] is None and got[None, 5] == got[None, 7] == 2.0
