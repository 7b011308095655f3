"""Time series: cycles of filters, gap-aware neighbourhoods, weights and normalisation over a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumastack.operators.windows import in_order, seconds


def cycle_bins(captures: DataFrame, minutes: float, required: list[str] | None = None, origin: Column | None = None) -> DataFrame:
    """(cycle_id, center_s, filter, stem, ts): in each bin of `minutes` from the first capture on, the capture of each filter nearest to the middle.

    The first wins ties. Bins without all required filters are dropped. The origin is the smallest time unless given; it
    is one row, joined to all.
    """
    width = minutes * 60.0
    timed = captures.withColumn("_s", seconds(F.col("ts")))
    if origin is None:
        timed = timed.join(F.broadcast(timed.agg(F.min("_s").alias("_t0"))))
    else:
        timed = timed.withColumn("_t0", origin)
    binned = timed.withColumn("cycle_id", F.floor((F.col("_s") - F.col("_t0")) / width)).withColumn("center_s", F.col("_t0") + (F.col("cycle_id") + 0.5) * width)
    near = F.row_number().over(Window.partitionBy("cycle_id", "filter").orderBy(F.abs(F.col("_s") - F.col("center_s")), "ts", "stem"))
    best = binned.withColumn("_n", near).where("_n = 1").select("cycle_id", "center_s", "filter", "stem", "ts")
    if not required:
        return best
    whole = best.where(F.col("filter").isin(*required)).groupBy("cycle_id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(required))
    return best.join(whole.select("cycle_id"), "cycle_id", "left_semi")


def cycle_islands(cycles: DataFrame, minutes: float) -> DataFrame:
    """Distinct cycles in time order with position and island: a new island starts where the gap exceeds two cycles.

    Positions and islands run over the whole series, by ranges of time (windows.in_order).
    """
    one = in_order(cycles.select("cycle_id", "center_s").distinct(), "center_s", 2 * minutes * 60)
    return one.select("cycle_id", "center_s", F.col("_island").alias("island"), F.col("_place").alias("position"))


def neighbourhoods(islands: DataFrame, n: int) -> DataFrame:
    """(cycle_id, near_id): cycles within n // 2 positions of each other in one island; even n gives n + 1."""
    half = n // 2
    left = islands.select("cycle_id", "island", F.explode(F.sequence(F.col("position") - half, F.col("position") + half)).alias("position"))
    right = islands.select(F.col("cycle_id").alias("near_id"), "island", "position")
    return left.join(right, ["island", "position"]).select("cycle_id", "near_id")


def window_midpoint(frames: DataFrame, by: str) -> DataFrame:
    """Half-way between the first and last time of each group, in seconds."""
    s = seconds(F.col("ts"))
    return frames.groupBy(by).agg(((F.min(s) + F.max(s)) / 2).alias("mid_s"))


def series_weights(frames: DataFrame, by: list[str], least: float, score_col: str = "score") -> DataFrame:
    """Adds weight: max(score squared, 0.05) as part of its group's sum, a missing score being 1; and n_below, the group's frames under `least`."""
    s = F.coalesce(F.col(score_col), F.lit(1.0))
    own = F.greatest(s * s, F.lit(0.05))
    total = frames.groupBy(*by).agg(F.sum(own).alias("_sum"), F.count(F.when(s < least, 1)).alias("n_below"))
    return frames.join(total, by).withColumn("weight", own / F.col("_sum")).drop("_sum")


def residual_shift(dt: Column, scale: Column, rate: Column, radius: Column) -> Column:
    """The horizontal shift that de-rotation leaves: (1 - scale) dt rate radius, 0 up to half a second."""
    return F.when(F.abs(dt) > 0.5, (1 - scale) * dt * rate * radius).otherwise(0.0)


def normalise_series(pixels: DataFrame, joint: tuple[str, ...] = ("R", "G", "B")) -> DataFrame:
    """Adds out: each frame's pixels shifted and scaled to the mean and deviation of its filter over the series.

    The joint filters share theirs. Deviations are at least 1e-7; values are clipped to 0..1. Statistics are aggregated and
    joined back.
    """
    group = F.when(F.col("filter").isin(*joint), "joint").otherwise(F.col("filter"))
    rows = pixels.withColumn("_g", group)
    frame = rows.groupBy("frame_id").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    whole = rows.groupBy("_g").agg(F.avg("v").alias("_gm"), F.stddev_pop("v").alias("_gs"))
    out = (F.col("v") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-7)) * F.col("_gs") + F.col("_gm")
    return rows.join(frame, "frame_id").join(F.broadcast(whole), "_g").withColumn("out", F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))).drop("_g", "_m", "_s", "_gm", "_gs")


def series_scale(v: Column, k: float = 0.8) -> Column:
    """Brightness times k, clipped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v * k))


def color_bins(captures: DataFrame, minutes: float) -> DataFrame:
    """(bin, center_ts, n, position): bins that have captures, numbered without gaps by ranges; the centre is the middle capture's time."""
    width = minutes * 60.0
    timed = captures.withColumn("_s", seconds(F.col("ts")))
    timed = timed.join(F.broadcast(timed.agg(F.min("_s").alias("_t0")))).withColumn("bin", F.floor((F.col("_s") - F.col("_t0")) / width))
    row = F.row_number().over(Window.partitionBy("bin").orderBy("ts", "stem"))
    counted = timed.groupBy("bin").agg(F.count("*").alias("n"))
    middle = timed.withColumn("_row", row).join(counted, "bin").where("_row = n DIV 2 + 1").select("bin", F.col("ts").alias("center_ts"), "n")
    return in_order(middle, "bin").select("bin", "center_ts", "n", F.col("_place").alias("position"))


def nearest_frame(frames: DataFrame, centers: DataFrame, by: list[str]) -> DataFrame:
    """For each row of centers (by columns, center_s) the frame of its group nearest in time; the earlier wins ties."""
    gap = F.abs(seconds(F.col("ts")) - F.col("center_s"))
    return frames.join(centers, by).groupBy(*by).agg(F.min_by("stem", F.struct(gap, F.col("ts"), F.col("stem"))).alias("stem"))


def luminance_match(composites: DataFrame, by: list[str]) -> DataFrame:
    """Composites (R, G, B by pixel) scaled to the mean brightness of all: frames under 1e-6 stay as they are. The goal is one row."""
    own = composites.groupBy(*by).agg(F.avg((F.col("R") + F.col("G") + F.col("B")) / 3).alias("_m"))
    goal = own.agg(F.avg("_m").alias("_goal"))
    scale = F.when(F.col("_m") > 1e-6, F.col("_goal") / F.col("_m")).otherwise(1.0)
    rows = composites.join(own.crossJoin(F.broadcast(goal)).select(*by, scale.alias("_s")), by)
    return rows.select(*by, "y", "x", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) * F.col("_s"))).alias(c) for c in "RGB"])
