"""A time series of composites from end to end: cycles, neighbourhoods without gaps, de-rotated stacks, one normalisation over the series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumastack.operators import kernels, series
from lumastack.operators.alignment import align_channels, pixel_table
from lumastack.operators.composite import compose_rgb
from lumastack.operators.derotate import FLATTEST, ROUNDEST, derotated, in_parts, stacked_frames
from lumastack.operators.frames import disk_ellipse, ellipses, per_stack
from lumastack.operators.sharpen import sharpened
from lumastack.operators.windows import seconds
from lumastack.sources.shared import materialise

#: Filters in the order in which a disk is looked for, and those that share one normalisation.
DISK_ORDER, JOINT = ("IR", "R", "G", "CH4", "B"), ("R", "G", "B")


def members(captures: DataFrame, minutes: float, n: int, required: list[str] | None = None, scores: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(cycle_id, near_id, middle, filter, stem, ts, score, weight, n_below, mid_s, dt_sec): what each cycle's frame of the series is made of.

    captures (stem, ts, filter) are binned into cycles; a cycle takes those within n // 2 positions of it, but none beyond a gap
    of two cycles. The middle one of them is flagged. Times are against half-way between the first and the last capture. Weights
    are max(score squared, 0.05) as part of a filter's sum; a capture without a score (stem, score) counts as 1.
    """
    bins = materialise(series.cycle_bins(captures, minutes, required))
    near = series.neighbourhoods(materialise(series.cycle_islands(bins, minutes)), n)
    order = Window.partitionBy("cycle_id").orderBy("near_id")  # of n + 1 rows at most
    near = near.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy("cycle_id")))
    near = near.select("cycle_id", "near_id", (F.col("_i") == F.expr("_n div 2 + 1")).alias("middle"))
    rows = near.join(bins.select(F.col("cycle_id").alias("near_id"), "filter", "stem", "ts"), "near_id")
    rows = rows.join(scores.select("stem", "score"), "stem", "left") if scores is not None else rows.withColumn("score", F.lit(1.0))
    rows = rows.withColumn("score", F.coalesce("score", F.lit(1.0))).join(series.window_midpoint(rows, "cycle_id"), "cycle_id")
    weighed = series.series_weights(rows, ["cycle_id", "filter"], least)
    return weighed.withColumn("dt_sec", seconds(F.col("ts")) - F.col("mid_s"))


def frame_log(rows: DataFrame) -> DataFrame:
    """(cycle_id, filter, n_used, n_below, avg_dt_sec, scores): a row for each stack of members(); scores in order of time."""
    g = rows.groupBy("cycle_id", "filter").agg(F.count("*").alias("n_used"), F.first("n_below").alias("n_below"), F.round(F.sum(F.col("weight") * F.col("dt_sec")), 1).alias("avg_dt_sec"), F.array_sort(F.collect_list(F.struct("ts", "stem", "score"))).alias("_s"))
    return g.select("cycle_id", "filter", "n_used", "n_below", "avg_dt_sec", F.transform("_s", lambda s: F.round(s["score"], 3)).alias("scores"))


def first_disk(disks: DataFrame, by: str, least: float) -> DataFrame:
    """(by, disk): [cx, cy, semi_major, semi_minor, angle] of the first filter in DISK_ORDER whose half axis is at least `least`."""
    place = F.array_position(F.array(*[F.lit(f) for f in DISK_ORDER]), F.col("filter"))
    found = disks.where((place > 0) & (F.col("semi_major") >= least))
    return found.groupBy(by).agg(F.min_by(F.array("cx", "cy", "semi_major", "semi_minor", "angle"), place).alias("disk"))


def turned_members(frames: DataFrame, rows: DataFrame, period_hours: float, scale: float, least: float) -> DataFrame:
    """(cycle_id, filter, weight, h, w, px): each member's frame turned to its cycle's middle of time about the disk of the middle cycle,
    then moved by what the warp leaves of the drift. Without such a disk a frame is turned about its own and not moved."""
    own = disk_ellipse(frames.join(rows.where("middle").select(F.col("stem").alias("frame_id")).distinct(), "frame_id", "left_semi"))
    shared = first_disk(rows.where("middle").join(own.withColumnRenamed("frame_id", "stem"), "stem"), "cycle_id", least)
    held = frames.select(F.col("frame_id").alias("stem"), "h", "w", "px").join(rows.select("cycle_id", "filter", "stem", "weight", "dt_sec"), "stem").join(shared, "cycle_id", "left")
    turn = 360 / (period_hours * 3600)

    def kernel(a, table):
        lone = np.array([d is None for d in table.column("disk").to_pylist()])
        found = np.array([d[:4] if d else (0.0,) * 4 for d in table.column("disk").to_pylist()])
        if lone.any():
            found[lone] = np.stack([v for k, v in ellipses(a[lone]).items() if k != "angle"], 1)
        cx, cy, major, minor = found.T
        ratio = np.clip(minor / np.maximum(major, 1.0), FLATTEST, ROUNDEST)
        dt = table.column("dt_sec").to_numpy(zero_copy_only=False)
        rest = np.where(lone | (np.abs(dt) <= 0.5), 0.0, (1 - scale) * np.radians(dt * turn) * major)

        def job(f, d, x, y, r, q, left):
            return kernels.shift(derotated(f, d * turn, (x, y, r), q, 0.0, scale), left, 0.0)

        return {"px": in_parts(a, job, dt, cx, cy, major, ratio, rest)}

    return per_stack(held, kernel, "px array<double>", ("cycle_id", "filter", "weight", "dt_sec", "disk", "h", "w")).drop("dt_sec", "disk")


def centred(stacks: DataFrame, by: str, least: float) -> DataFrame:
    """Stacks (by, filter, h, w, px) of a group moved together, so that the disk of its first filter (first_disk) is in the middle of the frame."""
    where = per_stack(stacks, lambda a, _: ellipses(a), "cx double, cy double, semi_major double, semi_minor double, angle double", (by, "filter"))
    rows = stacks.join(first_disk(where, by, least), by, "left")

    def kernel(a, table):
        h, w = a.shape[1:]
        by_ = np.array([(w / 2 - d[0], h / 2 - d[1]) if d else (0.0, 0.0) for d in table.column("disk").to_pylist()])
        return {"px": in_parts(a, kernels.shift, *by_.T)}

    return per_stack(rows, kernel, "px array<double>", (by, "filter", "h", "w", "disk")).drop("disk")


def normalised(stacks: DataFrame, by: str, joint: tuple[str, ...] = JOINT) -> DataFrame:
    """Stacks (by, filter, h, w, px) shifted and scaled to the mean and deviation of their filter over the series; the joint filters share theirs.

    Means are taken in each frame's array, so that no pixel is shuffled: a frame adds one row of numbers to the series' sums.
    Deviations are at least 1e-7.
    """
    group = F.when(F.col("filter").isin(*joint), "joint").otherwise(F.col("filter"))
    told = per_stack(stacks, lambda a, _: {"_m": a.mean((1, 2)), "_v": a.var((1, 2)), "_n": np.full(len(a), float(a[0].size))}, "_m double, _v double, _n double", (by, "filter")).withColumn("_g", group)
    n = F.sum("_n")
    whole = told.groupBy("_g").agg((F.sum(F.col("_n") * F.col("_m")) / n).alias("_gm"), (F.sum(F.col("_n") * (F.col("_v") + F.col("_m") * F.col("_m"))) / n).alias("_gq"))
    spread = F.sqrt(F.greatest(F.col("_gq") - F.col("_gm") * F.col("_gm"), F.lit(0.0)))
    numbers = told.join(whole, "_g").select(by, "filter", "_m", F.greatest(F.sqrt("_v"), F.lit(1e-7)).alias("_s"), "_gm", F.greatest(spread, F.lit(1e-7)).alias("_gs"))
    out = F.transform("px", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("_m")) / F.col("_s") * F.col("_gs") + F.col("_gm"))))
    return stacks.join(numbers, [by, "filter"]).select(by, "filter", "h", "w", out.alias("px"))


def shifted_back(stacks: DataFrame, by: str) -> DataFrame:
    """Stacks with each channel moved onto its group's reference channel (align_channels)."""
    found = align_channels(stacks, by).select(by, "filter", "dx", "dy")

    def kernel(a, table):
        return {"px": in_parts(a, kernels.shift, *(-table.column(c).to_numpy(zero_copy_only=False) for c in ("dx", "dy")))}

    return per_stack(stacks.join(found, [by, "filter"]), kernel, "px array<double>", (by, "filter", "h", "w", "dx", "dy")).drop("dx", "dy")


def series_frames(frames: DataFrame, minutes: float, n: int, *, required: list[str] | None = None, period_hours: float = 9.9281, scale: float = 0.8, least: float = 5.0, least_score: float = 0.3, amounts: list[float] | None = None, brightness: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The composites (cycle_id, name, y, x, R, G, B, L) of a series of frames (frame_id, filter, ts, score, h, w, px), and its log.

    Per cycle and filter: members de-rotated and stacked by weight, centred together, sharpened at the limb (if there are
    amounts), normalised over the series, composed and scaled. Channels are aligned only where n is 1: stacks of unequal
    sharpness would make the shifts unsteady. A frame goes to n (n + 1 if even) stacks; stacks are stored, as they are read twice.
    """
    rows = materialise(members(frames.select(F.col("frame_id").alias("stem"), "ts", "filter"), minutes, n, required, frames.select(F.col("frame_id").alias("stem"), "score"), least_score))
    stacks = materialise(stacked_frames(turned_members(frames, rows, period_hours, scale, least), ["cycle_id", "filter"], "weight").drop("n"))
    stacks = centred(stacks, "cycle_id", least)
    if amounts:
        stacks = sharpened(stacks, amounts, ("cycle_id", "filter"), least=least)
    even = normalised(materialise(stacks), "cycle_id")
    even = shifted_back(materialise(even), "cycle_id") if n == 1 else even
    even = even.withColumn("px", F.transform("px", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v * brightness))))
    return compose_rgb(pixel_table(even, "cycle_id", "filter"), "cycle_id"), frame_log(rows)
