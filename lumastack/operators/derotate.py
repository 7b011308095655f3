"""De-rotation and stacking of a window's frames: threshold, reference, warp, brightness, alignment, weighted stack, log."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.operators import kernels
from lumastack.operators.frames import ellipses, per_stack
from lumastack.operators.stack import rotation_delta
from lumastack.operators.windows import seconds
from lumastack.sources.shared import materialise

#: Pixels over which cubic resampling fades to linear at the limb, the padding of the warp's radius, and the bounds of a measured flattening.
LIMB_FADE, PADDING, FLATTEST, ROUNDEST = 12.0, 1.05, 0.85, 1.0


def derotated(frame: np.ndarray, delta: float, disk: tuple[float, float, float], ratio: float, pole: float, scale: float) -> np.ndarray:
    """One frame turned back by delta degrees: each pixel is fetched against the drift of an oblate disk (cx, cy, radius) whose axis is tilted by pole degrees.

    Cubic resampling inside, linear from the limb outwards; zero outside the frame. A stack is turned frame by frame where the
    numbers are (n, 1, 1).
    """
    cx, cy, radius = disk
    y, x = np.mgrid[: frame.shape[-2], : frame.shape[-1]].astype(float)
    c, s = np.cos(np.radians(pole)), np.sin(np.radians(pole))
    rx, ry = x - cx, y - cy
    depth2 = (PADDING * radius) ** 2 - (rx * c + ry * s) ** 2 - ((ry * c - rx * s) / ratio) ** 2
    drift = scale * np.radians(delta) * np.sqrt(np.maximum(0, depth2))
    sx, sy = x - drift * c, y - drift * s
    inner = np.clip((radius - np.hypot(rx, ry)) / LIMB_FADE, 0, 1)
    return np.clip(inner * kernels.remap(frame, sx, sy, "zero", clip=False) + (1 - inner) * kernels.remap_linear(frame, sx, sy), 0, 1)


#: Pixels that are resampled at once, which takes some twenty times their memory.
AT_ONCE = 500_000


def in_parts(a: np.ndarray, job, *numbers: np.ndarray) -> np.ndarray:
    """job(frames, numbers as (n, 1, 1)) over parts of a stack of at most AT_ONCE pixels."""
    step = max(1, AT_ONCE // (a.shape[1] * a.shape[2]))
    return np.concatenate([job(a[i : i + step], *(v[i : i + step, None, None] for v in numbers)) for i in range(0, len(a), step)])


def turned(frames: DataFrame, scale: float = 0.8) -> DataFrame:
    """Frames (with columns delta and pole, degrees) each turned back by delta about its own disk."""

    def kernel(a, rows):
        e = ellipses(a)
        ratio = np.clip(e["semi_minor"] / np.maximum(e["semi_major"], 1.0), FLATTEST, ROUNDEST)
        numbers = [rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("delta", "pole")]
        return {"px": in_parts(a, lambda f, d, p, cx, cy, r, q: derotated(f, d, (cx, cy, r), q, p, scale), *numbers, e["cx"], e["cy"], e["semi_major"], ratio)}

    return per_stack(frames, kernel, "px array<double>", tuple(c for c in frames.columns if c != "px"))


def disk_level(a: np.ndarray) -> np.ndarray:
    """For each frame the median of the pixels over 0.3 of the mean, in the middle box of half the shorter side."""
    h, w = a.shape[1:]
    r = int(min(h, w) * 0.25)
    box = a[:, h // 2 - r : h // 2 + r, w // 2 - r : w // 2 + r].reshape(len(a), -1)
    lit = box > 0.3 * box.mean(1, keepdims=True)
    return np.array([np.median(b[m]) if m.any() else np.median(b) for b, m in zip(box, lit, strict=True)])


def references(frames: DataFrame, by: list[str], center: str) -> DataFrame:
    """(by, ref_id, ref_dt, ref, disk): the frame of each group nearest in time to the group's `center` (seconds), the earlier of equals, its time against
    that, and its disk (cx, cy, radius, ratio). The frame is chosen by its numbers; only the pixels of those chosen are looked up."""
    dt = seconds(F.col("ts")) - F.col(center)
    near = F.struct(F.abs(dt), F.col("ts"), F.col("frame_id"))
    best = frames.groupBy(*by).agg(F.min_by(F.struct("frame_id", dt.alias("dt")), near).alias("r")).select(*by, F.col("r.frame_id").alias("ref_id"), F.col("r.dt").alias("ref_dt"))
    own = frames.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("frame_id").alias("_id"), "h", "w", "px")
    same = F.col("_id") == F.col("ref_id")
    for k in by:
        same &= F.col(f"_{k}").eqNullSafe(F.col(k))
    chosen = own.join(best, same).select(*by, "ref_id", "ref_dt", "h", "w", "px")

    def kernel(a, _):
        e = ellipses(a)
        ratio = np.clip(e["semi_minor"] / np.maximum(e["semi_major"], 1.0), FLATTEST, ROUNDEST)
        return {"ref": a, "disk": np.stack((e["cx"], e["cy"], e["semi_major"], ratio), 1)}

    return per_stack(chosen, kernel, "ref array<double>, disk array<double>", (*by, "ref_id", "ref_dt"))


def over_threshold(frames: DataFrame, by: list[str], threshold: float, score: str = "score") -> DataFrame:
    """Frames with at least the threshold; a group without any keeps all."""
    n = frames.groupBy(*by).agg(F.max((F.col(score) >= threshold).cast("int")).alias("_any"))
    return frames.join(n, by).where((F.col(score) >= threshold) | (F.col("_any") == 0)).drop("_any")


def derotated_frames(frames: DataFrame, by: list[str], center: str, pole: str | None = None, period_hours: float = 9.9281, scale: float = 0.8, match: bool = True, align: bool = True) -> DataFrame:
    """Frames (by, frame_id, ts, score, h, w, px, center, pole) turned to their group's centre of time and aligned to its reference.

    Returns by, frame_id, ts, score, ref_id, dt_sec, delta, disk, dx, dy (what was added to the place of the disk), method
    (reference, limb, phase or none), h, w, px. The reference's disk serves for all frames of a group. If match is set,
    brightness follows the reference's disk level (unless that is dark). Shifts come from the limb, the centre of the
    frame's own disk; where that fails (a radius under 5, a shift over 15 or none), from phase correlation.
    """
    refs = references(frames, by, center)
    rows = frames.join(refs, by).withColumn("dt_sec", seconds(F.col("ts")) - F.col(center)).withColumn("_pole", F.coalesce(F.col(pole), F.lit(0.0)) if pole else F.lit(0.0))
    rows = rows.withColumn("delta", rotation_delta(F.col("dt_sec"), period_hours)).withColumn("_ref_delta", rotation_delta(F.col("ref_dt"), period_hours))

    def turn(f, d, p, cx, cy, r, q):
        return derotated(f, d, (cx, cy, r), q, p, scale)

    def kernel(a, table):
        """A batch step by step: all its frames are turned, levelled and measured together; a group's reference is turned once."""
        ref = table.column("ref").flatten().to_numpy(zero_copy_only=False).reshape(a.shape)
        disk = table.column("disk").flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
        delta, ref_delta, pole_ = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("delta", "_ref_delta", "_pole"))
        groups: dict = {}
        group = np.array([groups.setdefault(key, len(groups)) for key in zip(*(table.column(c).to_pylist() for c in (*by, "_pole")), strict=True)])
        first = np.unique(group, return_index=True)[1]
        goals = in_parts(ref[first], turn, ref_delta[first], pole_[first], *disk[first].T)
        own = in_parts(a, turn, delta, pole_, *disk.T)
        other = np.array([i != r for i, r in zip(table.column("frame_id").to_pylist(), table.column("ref_id").to_pylist(), strict=True)], bool)
        own[~other] = goals[group[~other]]
        if match:
            wanted, level = disk_level(goals)[group], disk_level(own)
            at = other & (wanted >= 1e-6) & (level > 1e-6)
            own[at] = np.clip(own[at] * (wanted[at] / level[at])[:, None, None], 0, 1)
        dx, dy, method = np.zeros(len(a)), np.zeros(len(a)), np.where(other, "none", "reference").astype(object)
        if align and other.any():
            e = ellipses(own[other])
            dx[other], dy[other], method[other] = disk[other, 0] - e["cx"], disk[other, 1] - e["cy"], "limb"
            off = np.maximum(np.abs(dx[other]), np.abs(dy[other]))
            for i in np.flatnonzero(other)[(e["semi_major"] < 5) | (off > 15) | (off == 0)].tolist():
                px, py, _ = kernels.phase_shift(goals[group[i]], own[i][None])[0]
                dx[i], dy[i], method[i] = -px, -py, "phase"
            for i in np.flatnonzero(other).tolist():
                own[i] = kernels.shift(own[i], dx[i], dy[i])
        return {"px": own, "dx": dx, "dy": dy, "method": method.tolist()}

    keep = (*by, "frame_id", "ts", "score", "ref_id", "dt_sec", "delta", "disk", "h", "w", "ref", "_ref_delta", "_pole")
    return per_stack(rows, kernel, "px array<double>, dx double, dy double, method string", keep).drop("ref", "_ref_delta", "_pole")


def stacked_frames(frames: DataFrame, by: list[str], weight: str = "score") -> DataFrame:
    """(by, h, w, px, n): the mean of each group's frames by weight, 1e-9 at least; a single frame stays as it is.

    Tasks add up their own frames of a group and send the sums cut into blocks of BLOCK pixels, so a group costs a row for
    each task and block, and no pixel is a row of its own.
    """
    w = F.greatest(F.col(weight).cast("double"), F.lit(1e-9))
    sums = block_sums(frames.select(*by, "h", "w", w.alias("_w"), "px"), by)
    px = F.when(F.col("n") == 1, F.col("one")).otherwise(F.transform("total", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.col("w_sum")))))
    return sums.select(*by, "h", "w", "block", "n", px.alias("px")).groupBy(*by, "h", "w").agg(F.first("n").alias("n"), F.flatten(F.array_sort(F.collect_list(F.struct("block", "px")))["px"]).alias("px"))


#: Pixels that one row of partial sums has at most.
BLOCK = 16_384


def block_sums(rows: DataFrame, by: list[str], groups: int = 64) -> DataFrame:
    """(by, h, w, block, n, w_sum, total, one): sums of _w * px by blocks of pixels; `one` are some frame's pixels. A task holds at most `groups` groups."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [rows.schema[k] for k in (*by, "h", "w")]
    made = T.StructType([*keys, *T._parse_datatype_string("block int, n bigint, w_sum double, total array<double>, one array<double>").fields])

    def told(held: dict):
        for key, (n, weight, total, one) in held.items():
            starts = range(0, len(total), BLOCK)
            columns = [[k] * len(starts) for k in key] + [list(range(len(starts))), [n] * len(starts), [weight] * len(starts), [total[i : i + BLOCK] for i in starts], [one[i : i + BLOCK] for i in starts]]
            schema = to_arrow_schema(made)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def partial(batches):
        held: dict = {}
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in (*by, "h", "w")), strict=True))
            for i, (key, weight) in enumerate(zip(names, batch.column("_w").to_pylist(), strict=True)):
                px = batch.column("px")[i].values.to_numpy(zero_copy_only=False)
                if len(px) != key[-1] * key[-2]:
                    continue
                if key in held:
                    n, before, total, one = held[key]
                    held[key] = (n + 1, before + weight, total + weight * px, one)
                else:
                    if len(held) >= groups:
                        yield from told(held)
                        held = {}
                    held[key] = (1, weight, weight * px, px)
        yield from told(held)

    def merged(batches):
        """Rows come in order of their keys, so only the sums of one key are held."""
        names, schema = (*by, "h", "w", "block"), to_arrow_schema(made)
        key, sums, done = None, [], []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in names), strict=True)
            numbers = zip(batch.column("n").to_pylist(), batch.column("w_sum").to_pylist(), strict=True)
            totals, ones = batch.column("total"), batch.column("one")
            for i, (new, (n, weight)) in enumerate(zip(keys, numbers, strict=True)):
                total = totals[i].values.to_numpy(zero_copy_only=False)
                if new == key:
                    sums = [sums[0] + n, sums[1] + weight, sums[2] + total, sums[3]]
                    continue
                if key is not None:
                    done.append((*key, *sums))
                if len(done) >= groups:
                    yield batch_of(done)
                    done = []
                key, sums = new, [n, weight, total, ones[i].values.to_numpy(zero_copy_only=False)]
        if key is not None:
            done.append((*key, *sums))
        if done:
            yield batch_of(done)

    order = (*by, "h", "w", "block")
    return rows.where("px IS NOT NULL").mapInArrow(partial, made).repartition(*order).sortWithinPartitions(*order).mapInArrow(merged, made)


def derotate_stack(frames: DataFrame, by: list[str], center: str, pole: str | None = None, threshold: float = 0.0, **options) -> tuple[DataFrame, DataFrame]:
    """The stack (by, h, w, px, n) of each group's de-rotated frames, weighted by score, and the log: a row for each frame.

    The frames given are stored once, so that what scored and timed them runs once, whatever is asked of stack and log.
    """
    made = derotated_frames(over_threshold(materialise(frames), by, threshold), by, center, pole, **options)
    log = made.select(*by, "frame_id", "ts", F.round("score", 4).alias("norm_score"), F.round("dt_sec", 2).alias("dt_sec"), F.transform(F.slice("disk", 1, 2), lambda v: F.round(v, 2)).alias("disk_center_px"), F.round(F.col("disk")[2], 2).alias("disk_radius_px"),
                      F.round("delta", 4).alias("delta_lambda_deg"), F.array(F.round("dx", 3), F.round("dy", 3)).alias("align_shift_px"), F.col("method").alias("align_method"), (F.col("frame_id") == F.col("ref_id")).alias("is_reference"))
    return stacked_frames(made, by), log
