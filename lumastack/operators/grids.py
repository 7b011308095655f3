"""Alignment points of frames: grid points whose patch lies in the frame and on the disk, varies enough and is bright enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumastack.operators.contours import ellipses

#: Pixels that are looked at together.
STACK = 4_000_000
DISK = ("cx", "cy", "radius")


def patch_moments(stack: np.ndarray, xs: np.ndarray, ys: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the patches around (xs[i], ys[j]) of n frames, each (n, ys, xs), from summed-area tables: four places of a
    table make a patch, whatever its size. Values are taken from the frame's mean, so that squares keep their digits."""
    middle = stack.mean((1, 2), keepdims=True)
    off = stack - middle

    def sums(values: np.ndarray) -> np.ndarray:
        table = np.pad(values.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        top, bottom, left, right = ys - half, ys + half, xs - half, xs + half
        return table[:, bottom][:, :, right] - table[:, top][:, :, right] - table[:, bottom][:, :, left] + table[:, top][:, :, left]

    n = 4 * half * half
    mean = sums(off) / n
    return mean + middle, np.sqrt(np.maximum(0, sums(off * off) / n - mean * mean))


def grid_points(stack: np.ndarray, disk: np.ndarray | None, step: int, size: int, least_std: float, least_of_peak: float, *, to_the_end: bool = False) -> np.ndarray:
    """(frame, x, y) of the points kept, frame by frame, row by row. disk: (cx, cy, radius) of each frame; NaN, or no disk at all, asks no test.

    Without a least_of_peak over 0 brightness is not looked at. A point's patch of `size` lies in the frame; the last row and column that would just fit are left out unless to_the_end.
    """
    n, h, w = stack.shape
    half = size // 2
    if half < 1:
        raise ValueError("a patch has at least two pixels a side")
    ys, xs = (np.arange(half, side - half + to_the_end, step) for side in (h, w))
    if not len(ys) or not len(xs):
        return np.zeros((0, 3), np.int64)
    mean, deviation = patch_moments(stack, xs, ys, half)
    keep = deviation >= least_std
    if least_of_peak > 0:
        keep &= mean >= least_of_peak * stack.max((1, 2), keepdims=True)
    if disk is not None:
        cx, cy, radius = (disk[:, i, None, None] for i in range(3))
        keep &= ~((xs[None, None, :] - cx) ** 2 + (ys[None, :, None] - cy) ** 2 >= radius**2)
    frame, y, x = np.nonzero(keep)
    return np.column_stack((frame, xs[x], ys[y]))


def points_of(batch: pa.RecordBatch, step: int, size: int, least_std: float, least_of_peak: float, *, find_disk: bool, to_the_end: bool) -> Iterator[pa.RecordBatch]:
    """(row of the batch, ax, ay) of the frames (h, w, px[, cx, cy, radius]) of a batch, those of one shape together. Frames without h times w pixels have no points."""
    h, w = (np.nan_to_num(batch.column(k).to_numpy(zero_copy_only=False)).astype(np.int64) for k in ("h", "w"))
    lengths = pa.compute.fill_null(pa.compute.list_value_length(batch.column("px")), -1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero((lengths == h * w) & (h > 0))
    given = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in DISK] if all(c in batch.schema.names for c in DISK) else None
    for shape in np.unique(np.column_stack((h, w))[good], axis=0).tolist():
        at = good[(h[good] == shape[0]) & (w[good] == shape[1])]
        for i in range(0, len(at), max(1, STACK // (shape[0] * shape[1]))):
            own = at[i : i + max(1, STACK // (shape[0] * shape[1]))]
            stack = batch.column("px").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)
            disk = None
            if find_disk:
                e = ellipses(stack)
                disk = np.column_stack((e["cx"], e["cy"], e["semi_major"]))
            elif given:
                disk = np.column_stack(given)[own]
            found = grid_points(stack, disk, step, size, least_std, least_of_peak, to_the_end=to_the_end)
            yield pa.RecordBatch.from_pydict({"row": own[found[:, 0]], "ax": pa.array(found[:, 1], pa.int32()), "ay": pa.array(found[:, 2], pa.int32())})


def ap_grid(frames: DataFrame, step: int, size: int, least_std: float, least_of_peak: float, *, find_disk: bool = False, to_the_end: bool = False) -> DataFrame:
    """(frame_id, ax, ay): the grid points of each frame (frame_id, h, w, px) whose patch of `size` has at least the deviation and, against the frame's
    peak, the brightness asked for.

    With columns cx, cy and radius a point must lie nearer to (cx, cy) than radius, where these are not null; with find_disk the disk is that of
    contours.ellipses. A narrow job on whole frames; no pixel becomes a row. Frames without h times w pixels have no points.
    """
    held = [c for c in DISK if c in frames.columns and not find_disk]
    rows = frames.select("frame_id", "h", "w", F.col("px").cast("array<double>").alias("px"), *held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in points_of(batch, step, size, least_std, least_of_peak, find_disk=find_disk, to_the_end=to_the_end):
                yield pa.RecordBatch.from_arrays([batch.column("frame_id").take(found.column("row")), found.column("ax"), found.column("ay")], names=["frame_id", "ax", "ay"])

    return rows.mapInArrow(run, T.StructType([rows.schema["frame_id"], T.StructField("ax", T.IntegerType()), T.StructField("ay", T.IntegerType())]))


class ApGrid:
    """The same as a table function: ap_grid(TABLE(SELECT frame_id, h, w, px[, cx, cy, radius] ...) [PARTITION BY ...], step, size, least_std, least_of_peak).

    frame_id is a number or a name and comes back as text with the points, since a table function has one type of result.
    """

    def eval(self, rows: pa.RecordBatch, step: pa.Array, size: pa.Array, least_std: pa.Array, least_of_peak: pa.Array) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            fixed = step[0].as_py(), size[0].as_py(), float(least_std[0].as_py()), float(least_of_peak[0].as_py())
            for found in points_of(rows, *fixed, find_disk=False, to_the_end=False):
                name = pa.compute.cast(rows.column("frame_id"), pa.string()).take(found.column("row"))
                yield pa.RecordBatch.from_arrays([name, found.column("ax"), found.column("ay")], names=["frame_id", "ax", "ay"])


#: The result of the table function.
AP_GRID_TYPE = "frame_id string, ax int, ay int"
