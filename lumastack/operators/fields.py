"""Displacement fields and patch stacks made inside tasks: frames and patches move as arrays, no pixel is a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumastack.operators import kernels
from lumastack.operators.frames import per_stack

#: Numbers that a task's patch sums hold before it sends them.
HELD = 4_000_000


def bells(at: np.ndarray, n: int, sigma: float, reach: int) -> np.ndarray:
    """A Gaussian around each place over n pixels, 0 beyond reach: (places, n)."""
    off = np.arange(n)[None] - at[:, None]
    return np.where(np.abs(off) <= reach, np.exp(-(off**2) / (2 * sigma * sigma)), 0.0)


def spread(points: np.ndarray, h: int, w: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """The field (dx, dy) of points (ax, ay, dx, dy, conf): a Gaussian in two dimensions is one in each, so each sum over the points is a
    product of two matrices."""
    reach = int(3 * sigma) + 1
    ax, ay, dx, dy, conf = points.T
    gy, gx = bells(ay, h, sigma, reach).T, bells(ax, w, sigma, reach)
    weight, x, y = (gy @ (c[:, None] * gx) for c in (conf, conf * conf * dx, conf * conf * dy))
    sure = (weight >= 0.05 * weight.max()) & (len(points) >= 3) & (weight != 0)
    safe = np.where(sure, weight, 1.0)
    return np.where(sure, x / safe, 0.0), np.where(sure, y / safe, 0.0)


def points_by_frame(points: DataFrame) -> DataFrame:
    """(frame_id, points): a frame's alignment points as one list, in order of place."""
    point = F.struct("ay", "ax", *(F.col(c).cast("double").alias(c) for c in ("dx", "dy", "conf")))
    return points.groupBy("frame_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def listed(column: pa.Array, i: int) -> np.ndarray:
    """The points of row i as an array (ax, ay, dx, dy, conf)."""
    own = column[i].values
    return np.column_stack([own.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("ax", "ay", "dx", "dy", "conf")])


def warp_fields(points: DataFrame, h: int, w: int, sigma: float) -> DataFrame:
    """(frame_id, h, w, dx, dy): displacements at alignment points (frame_id, ax, ay, dx, dy, conf) spread by a Gaussian over frames of h times w pixels, as arrays.

    The weight of a point is its confidence, once in the sum and once more in the shift; pixels with under 5 % of the frame's largest weight,
    and frames with fewer than three points, get 0. The points of a frame come together in one row, the field is made of them in the task.
    """
    rows = points_by_frame(points)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [spread(listed(batch.column("points"), i), h, w, sigma) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("frame_id"), pa.array([h] * len(made), pa.int32()), pa.array([w] * len(made), pa.int32()), *(pa.array([m[k].ravel() for m in made], pa.list_(pa.float64())) for k in range(2))], names=["frame_id", "h", "w", "dx", "dy"])

    return rows.mapInArrow(make, T.StructType([rows.schema["frame_id"], *T._parse_datatype_string("h int, w int, dx array<double>, dy array<double>").fields]))


def warp_field(points: DataFrame, h: int, w: int, sigma: float) -> DataFrame:
    """(frame_id, y, x, dx, dy): warp_fields as a row for each pixel, for those who want it so."""
    each = warp_fields(points, h, w, sigma).select("frame_id", "w", F.posexplode(F.arrays_zip("dx", "dy")).alias("_i", "_d"))
    return each.select("frame_id", F.expr("cast(_i div w as int)").alias("y"), (F.col("_i") % F.col("w")).alias("x"), "_d.dx", "_d.dy")


def remap_frames(frames: DataFrame, points: DataFrame, sigma: float, gx: Column, gy: Column) -> DataFrame:
    """(frame_id, h, w, px): frames resampled once at their pixel's place plus the field of their own points plus the global shift (gx, gy).

    Only the points are joined to the frames; the field exists inside the task. A frame without points is moved by the global shift alone.
    """
    rows = frames.join(points_by_frame(points), "frame_id", "left").withColumn("gx", gx.cast("double")).withColumn("gy", gy.cast("double"))

    def kernel(a, table):
        _, h, w = a.shape
        y, x = np.mgrid[:h, :w].astype(float)
        held, out = table.column("points"), []
        for i, (f, sx, sy) in enumerate(zip(a, table.column("gx").to_pylist(), table.column("gy").to_pylist(), strict=True)):
            dx, dy = spread(listed(held, i), h, w, sigma) if held[i].is_valid else (0.0, 0.0)
            out.append(kernels.remap(f, x + sx + dx, y + sy + dy, "mirror"))
        return {"px": np.stack(out)}

    return per_stack(rows, kernel, "px array<double>", ("frame_id", "h", "w", "points", "gx", "gy")).drop("points", "gx", "gy")


# -- patch stacks -------------------------------------------------------------------------------------------------------
PATCH = "y0 int, x0 int, ph int, pw int, weight double, total array<double>"


def patch_of(frame: np.ndarray, reference: np.ndarray, ax: int, ay: int, size: int) -> tuple[int, int, np.ndarray]:
    """(y0, x0, values): the patch of twice the size around a point, fetched between pixels after its middle was aligned to the same place of the
    reference by cross-correlation; a shift over half the patch counts as none."""
    h, w = frame.shape
    half = size // 2
    box = np.s_[max(0, ay - half) : min(h, ay + half), max(0, ax - half) : min(w, ax + half)]
    dx, dy, _ = kernels.ncc_shift(reference[box], frame[box][None])[0]
    if max(abs(dx), abs(dy)) > half:
        dx = dy = 0.0
    ys, xs = np.arange(max(0, ay - size), min(h, ay + size)), np.arange(max(0, ax - size), min(w, ax + size))
    fx, fy = np.clip(xs + dx, 0, w - 1), np.clip(ys + dy, 0, h - 1)
    ix, iy = np.minimum(fx.astype(int), w - 2), np.minimum(fy.astype(int), h - 2)
    tx, ty = (fx - ix)[None], (fy - iy)[:, None]
    at = lambda j, i: frame[np.ix_(iy + j, ix + i)]
    return int(ys[0]), int(xs[0]), (1 - ty) * ((1 - tx) * at(0, 0) + tx * at(0, 1)) + ty * ((1 - tx) * at(1, 0) + tx * at(1, 1))


def patch_sums(frames: DataFrame, picks: DataFrame, references: DataFrame, size: int, by: str) -> DataFrame:
    """(by, ap_id, ax, ay, y0, x0, ph, pw, weight, total): the weighted sum of the aligned patches of each point over the frames picked for it.

    A task adds up the patches of its own frames by (by, point) and sends each sum as one row, so rows follow points and tasks, not frames and
    pixels; it sends early when it holds HELD numbers. Sums of a point are added in the order of the tasks.
    """
    own = picks.groupBy(by, "frame_id").agg(F.array_sort(F.collect_list(F.struct("ap_id", "ax", "ay", F.col("weight").cast("double").alias("weight")))).alias("aps"))
    rows = frames.join(own, [by, "frame_id"]).join(references.select(by, "h", "w", F.col("px").cast("array<double>").alias("ref")), [by, "h", "w"])
    rows = rows.where((F.size("px") == F.col("h") * F.col("w")) & (F.size("ref") == F.size("px"))).select(by, "h", "w", F.col("px").cast("array<double>").alias("px"), "ref", "aps")
    ids = {f.name: f for f in own.schema["aps"].dataType.elementType.fields}
    schema = T.StructType([rows.schema[by], *(ids[c] for c in ("ap_id", "ax", "ay")), *T._parse_datatype_string("part int, " + PATCH).fields])
    arrow, names = to_arrow_schema(schema), (by, "ap_id", "ax", "ay")

    def batch(held: dict, part: int) -> pa.RecordBatch:
        data = {k: [key[i] for key in held] for i, k in enumerate(names)} | {"part": [part] * len(held)}
        data |= {"y0": [v[0] for v in held.values()], "x0": [v[1] for v in held.values()], "ph": [v[3].shape[0] for v in held.values()], "pw": [v[3].shape[1] for v in held.values()], "weight": [v[2] for v in held.values()], "total": [v[3].ravel() for v in held.values()]}
        return pa.RecordBatch.from_pydict(data, schema=arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, part = {}, 0, TaskContext.get().partitionId()
        for b in batches:
            keys, hs, ws, aps = (b.column(c).to_pylist() for c in (by, "h", "w", "aps"))
            for i in range(b.num_rows):
                frame, ref = (b.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(hs[i], ws[i]) for c in ("px", "ref"))
                for p in aps[i]:
                    key = (keys[i], p["ap_id"], p["ax"], p["ay"])
                    y0, x0, values = patch_of(frame, ref, p["ax"], p["ay"], size)
                    if key in held:
                        before = held[key]
                        held[key] = (y0, x0, before[2] + p["weight"], before[3] + p["weight"] * values)
                    else:
                        held[key], numbers = (y0, x0, p["weight"], p["weight"] * values), numbers + values.size
                if numbers > HELD:
                    yield batch(held, part)
                    held, numbers = {}, 0
        if held:
            yield batch(held, part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of points: those of one point, which lie together, become one."""
        now, sums = None, None
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in (*names, "y0", "x0", "ph", "pw", "weight")}
            for i in range(b.num_rows):
                key = tuple(columns[c][i] for c in names)
                total = b.column("total")[i].values.to_numpy(zero_copy_only=False).reshape(columns["ph"][i], columns["pw"][i])
                if key == now:
                    sums = (*sums[:2], sums[2] + columns["weight"][i], sums[3] + total)
                    continue
                if now is not None:
                    yield batch({now: sums}, 0)
                now, sums = key, (columns["y0"][i], columns["x0"][i], columns["weight"][i], total)
        if now is not None:
            yield batch({now: sums}, 0)

    partial = rows.mapInArrow(add, schema)
    return partial.repartition(*names).sortWithinPartitions(*names, "part").mapInArrow(merge, schema).drop("part")


def patch_stack(frames: DataFrame, picks: DataFrame, references: DataFrame, size: int, by: str = "file_id", base: DataFrame | None = None, rolloff: float = 0.0) -> DataFrame:
    """(by, h, w, px): the patches of each alignment point averaged over the frames picked for it, then blended by a Gaussian of 2 size / 3 around the points.

    picks has by, frame_id, ap_id, ax, ay, weight: at most one row a point and frame. Where no patch reaches, 0; with a base (by, h, w, px), that,
    added to all with a weight of 0.001, and the Gaussian is of size / 4. A rolloff over 0 is the deviation of a Gaussian over frequencies that the
    stack is faded by in the end. Frames of another shape than their reference's are left out. A group's averaged patches, as many as it has points,
    are blended into its one frame as they stream past.
    """
    sums = patch_sums(frames, picks, references, size, by)
    sigma = 2 * size / 3 if base is None else size / 4
    held = references.select(by, "h", "w")
    held = held.join(base.select(by, F.col("px").cast("array<double>").alias("base")), by, "left") if base is not None else held.withColumn("base", F.lit(None).cast("array<double>"))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in sums.schema.fields if f.name != by}
    kinds = [F.lit(None).cast(t).alias(c) for c, t in (("h", "int"), ("w", "int"), ("base", "array<double>"))]
    first = held.select(by, F.lit(0).alias("kind"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "base", *none.values())
    rows = first.unionByName(sums.select(by, F.lit(1).alias("kind"), *kinds, *none))
    schema = T.StructType([sums.schema[by], *T._parse_datatype_string("h int, w int, px array<double>").fields])

    def frame(key, top: np.ndarray, bottom: np.ndarray) -> pa.RecordBatch:
        made = np.clip(np.where(bottom > 0, top / np.where(bottom > 0, bottom, 1), 0), 0, 1)
        made = kernels.rolled_off(made[None], rolloff)[0] if rolloff else made
        return pa.RecordBatch.from_pydict({by: [key], "h": [made.shape[0]], "w": [made.shape[1]], "px": [made.ravel()]}, schema=to_arrow_schema(schema))

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by group, the group's own shape first."""
        now, top, bottom = None, None, None
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in (by, "kind", "h", "w", "ax", "ay", "y0", "x0", "ph", "pw", "weight")}
            for i in range(b.num_rows):
                c = {k: v[i] for k, v in columns.items()}
                if c["kind"] == 0:
                    if now is not None:
                        yield frame(now[0], top, bottom)
                    now, shape = (c[by],), (c["h"], c["w"])
                    own = b.column("base")[i]
                    top = 1e-3 * own.values.to_numpy(zero_copy_only=False).reshape(shape) if own.is_valid else np.zeros(shape)
                    bottom = np.full(shape, 1e-3) if own.is_valid else np.zeros(shape)
                    continue
                y, x = (np.arange(c[a], c[a] + c[n]) for a, n in (("y0", "ph"), ("x0", "pw")))
                g = np.exp(-((x[None] - c["ax"]) ** 2 + (y[:, None] - c["ay"]) ** 2) / (2 * sigma * sigma))
                box = np.s_[y[0] : y[-1] + 1, x[0] : x[-1] + 1]
                top[box] += g * b.column("total")[i].values.to_numpy(zero_copy_only=False).reshape(len(y), len(x)) / c["weight"]
                bottom[box] += g
        if now is not None:
            yield frame(now[0], top, bottom)

    return rows.repartition(by).sortWithinPartitions(by, "kind", "ap_id", "ax", "ay").mapInArrow(blend, schema)
