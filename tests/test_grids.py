"""Alignment grids against the rule point by point, as a job and as a table function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.functions.sql import register_functions
from lumastack.operators import grids


def plain(image, step, size, least_std, least_of_peak, disk=None, to_the_end=False):
    h, w = image.shape
    half, out = size // 2, []
    for y in range(half, h - half + to_the_end, step):
        for x in range(half, w - half + to_the_end, step):
            patch = image[y - half : y + half, x - half : x + half]
            inside = disk is None or (x - disk[0]) ** 2 + (y - disk[1]) ** 2 < disk[2] ** 2
            if inside and patch.std() >= least_std and patch.mean() >= least_of_peak * image.max():
                out.append((x, y))
    return out


def images():
    r = np.random.default_rng(4)
    y, x = np.mgrid[:40, :50]
    disk = ((x - 24) ** 2 + (y - 19) ** 2 < 15**2) * 0.7
    return [disk * (1 + 0.1 * r.random((40, 50))), r.random((33, 20)), np.full((12, 12), 0.5), 1000 + r.random((25, 25)), r.random((3, 3))]


def table(spark, disk=False):
    rows = [(i, *a.shape, a.ravel().tolist(), 24.0 if i == 0 else None, 19.0 if i == 0 else None, 15.0 if i == 0 else None) for i, a in enumerate(images())]
    rows += [(7, 4, 4, [0.5] * 15, 1.0, 1.0, 1.0), (8, 4, 4, None, 1.0, 1.0, 1.0), (9, 0, 0, [], 1.0, 1.0, 1.0), (10, None, None, [0.1], None, None, None)]
    df = spark.createDataFrame(rows, "frame_id long, h int, w int, px array<double>, cx double, cy double, radius double").withColumn("row", F.lit("x"))
    return (df if disk else df.drop("cx", "cy", "radius")).repartition(3)


@pytest.mark.parametrize(("step", "size", "least_std", "least_of_peak"), [(3, 6, 0.02, 0.5), (1, 2, 0.0, 0.0), (4, 8, 0.25, 0.2), (2, 5, 0.2, 0.0), (2, 30, 0.0, 0.0)])
@pytest.mark.parametrize("to_the_end", [False, True])
def test_points_equal_the_rule(spark, step, size, least_std, least_of_peak, to_the_end):
    for disk in (False, True):
        got = grids.ap_grid(table(spark, disk), step, size, least_std, least_of_peak, to_the_end=to_the_end).collect()
        want = [(i, *p) for i, a in enumerate(images()) for p in plain(a, step, size, least_std, least_of_peak, (24, 19, 15) if disk and i == 0 else None, to_the_end)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_the_disk_is_found(spark):
    got = [r for r in grids.ap_grid(table(spark, True), 3, 6, 0.0, 0.0, find_disk=True).collect() if r["frame_id"] == 0]
    assert got and all((r["ax"] - 24) ** 2 + (r["ay"] - 19) ** 2 < 15.5**2 for r in got) and len(got) < len(plain(images()[0], 3, 6, 0, 0))
    assert grids.ap_grid(table(spark).limit(0), 3, 6, 0.0, 0.0).count() == 0
    with pytest.raises(Exception, match="two pixels"):
        grids.ap_grid(table(spark), 1, 1, 0.0, 0.0).collect()


@pytest.mark.parametrize("partition", ["", "PARTITION BY (frame_id)"])
def test_table_function(spark, partition):
    register_functions(spark)
    for disk in (False, True):
        table(spark, disk).createOrReplaceTempView("grid_rows")
        got = spark.sql(f"SELECT * FROM ap_grid(TABLE(SELECT * FROM grid_rows) {partition}, 3, 6, 0.02D, 0.5D)").collect()
        want = grids.ap_grid(table(spark, disk), 3, 6, 0.02, 0.5).collect()
        assert sorted(map(tuple, got)) == sorted((str(r["frame_id"]), r["ax"], r["ay"]) for r in want) and got
        joined = spark.sql(f"SELECT f.frame_id, count(*) AS n FROM grid_rows f JOIN ap_grid(TABLE(SELECT * FROM grid_rows) {partition}, 3, 6, 0.02D, 0.5D) g ON g.frame_id = f.frame_id GROUP BY ALL")
        assert joined.count() == len({r["frame_id"] for r in want})
