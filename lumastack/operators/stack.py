"""Pixelwise aggregates over many frames, selection of frames, and geometry as column expressions.

Pixel tables have frame_id, y, x, v and the frame's columns. Stacks are plain aggregations by (group, y, x), which Spark
combines before the shuffle: a group with very many frames costs a row per pixel and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumastack.operators.windows import ranked


def clip01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def weighted_stack(pixels: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """(by, y, x, v, n): the mean weighted by `weight`, 1e-9 at least; a group of one frame is left as it is."""
    w = F.greatest(weight, F.lit(1e-9))
    g = pixels.groupBy(*by, "y", "x").agg(F.sum(w * F.col("v")).alias("_a"), F.sum(w).alias("_w"), F.count("*").alias("n"), F.first("v").alias("_v"))
    return g.select(*by, "y", "x", F.when(F.col("n") == 1, F.col("_v")).otherwise(clip01(F.col("_a") / F.col("_w"))).alias("v"), "n")


def power_stack(pixels: DataFrame, by: list[str], score: Column, power: float = 3.0) -> DataFrame:
    """weighted_stack with the score to a power as weight."""
    return weighted_stack(pixels, by, F.pow(score, F.lit(power)))


def mean_stack(pixels: DataFrame, by: list[str]) -> DataFrame:
    """The plain mean."""
    return pixels.groupBy(*by, "y", "x").agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def sigma_clip_stack(pixels: DataFrame, by: list[str], kappa: float = 2.0) -> DataFrame:
    """The mean of values within kappa deviations (1e-6 at least) of the pixel's mean, of all if none is; and the part clipped.

    Two passes: statistics by pixel, joined back, and the mean of what is kept. A window would bring a pixel's values of
    all frames into one task; the join only brings two numbers to each.
    """
    key = [*by, "y", "x"]
    stats = pixels.groupBy(*key).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    kept = F.when(F.abs(F.col("v") - F.col("_m")) <= kappa * F.greatest(F.col("_s"), F.lit(1e-6)), F.col("v"))
    g = pixels.join(stats, key).groupBy(*key).agg(F.avg(kept).alias("_k"), F.first("_m").alias("_m"), F.count(kept).alias("_n"), F.count("*").alias("n"))
    return g.select(*key, F.coalesce("_k", "_m").alias("v"), (1 - F.col("_n") / F.col("n")).alias("clipped"))


def disk_median(pixels: DataFrame, by: list[str]) -> DataFrame:
    """The median of the central half's pixels over 0.3 of their mean, by group."""
    middle = pixels.where((F.col("y") >= F.col("h") / 4) & (F.col("y") < F.col("h") * 3 / 4) & (F.col("x") >= F.col("w") / 4) & (F.col("x") < F.col("w") * 3 / 4))
    mean = middle.groupBy(*by).agg(F.avg("v").alias("_m"))
    return middle.join(mean, by).where(F.col("v") > 0.3 * F.col("_m")).groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("median"))


def brightness_match(frames: DataFrame, reference: Column, by: str) -> DataFrame:
    """Frames scaled to the disk median of their group's reference frame (the first where `reference` holds), which stays as it is;
    groups with a dark reference stay too, as do dark frames. Frames are measured and scaled whole; only numbers are joined."""
    level = F.array_compact(F.transform("px", lambda v, i: F.when(_middle(i), v)))
    lit = F.transform(F.array(level), lambda m: F.array_sort(F.filter(m, lambda v: v > 0.3 * F.aggregate(m, F.lit(0.0), lambda a, v: a + v) / F.size(m))))[0]
    median = F.transform(F.array(lit), lambda m: (F.get(m, F.expr("0") + F.floor((F.size(m) - 1) / 2).cast("int")) + F.get(m, F.floor(F.size(m) / 2).cast("int"))) / 2)[0]
    measured = frames.select("frame_id", by, reference.alias("_ref"), median.alias("_m"))
    target = measured.where("_ref").groupBy(by).agg(F.min(F.struct("frame_id", "_m")).alias("_t")).select(by, F.col("_t.frame_id").alias("_ref_id"), F.col("_t._m").alias("_goal"))
    scale = measured.join(target, by, "left").select(F.col("frame_id").alias("_id"), F.when((F.col("frame_id") == F.col("_ref_id")) | F.coalesce(F.col("_goal") < 1e-6, F.lit(True)) | F.coalesce(F.col("_m") < 1e-6, F.lit(True)), F.lit(None)).otherwise(F.col("_goal") / F.col("_m")).alias("_scale"))
    rows = frames.join(scale, F.col("frame_id") == F.col("_id"))
    return rows.withColumn("px", F.when(F.col("_scale").isNull(), F.col("px")).otherwise(F.transform("px", lambda v: clip01(v * F.col("_scale"))))).drop("_id", "_scale")


def _middle(i: Column) -> Column:
    """Whether the i-th pixel lies in the central half of the frame in both directions."""
    h, w = F.col("h"), F.col("w")
    y, x = F.floor(i / w), i % w
    return (y >= h / 4) & (y < h * 3 / 4) & (x >= w / 4) & (x < w * 3 / 4)


def select_top(scores: DataFrame, by: str, part: float, least: int, score: str = "score", order: str = "frame_id") -> DataFrame:
    """The best part of each file's frames, at least `least`, with their place from 1; ties to the later frame. Files of any size (ranked)."""
    n = scores.groupBy(by).agg(F.count("*").alias("_n"))
    wanted = F.least(F.greatest(F.lit(least), F.floor(F.col("_n") * part).cast("int")), F.col("_n"))
    return ranked(scores, by, F.desc(score), F.desc(order), name="place").join(n, by).where(F.col("place") <= wanted).drop("_n")


def reference_band(scores: DataFrame, by: str, n: int, midpoint: float = 0.75, score: str = "score", order: str = "frame_id") -> DataFrame:
    """n frames of each file around a quantile of quality (ascending; place from 0), moved in where they would reach over an end."""
    total = scores.groupBy(by).agg(F.count("*").alias("_n"))
    first = F.greatest(F.lit(0), F.least(F.floor(F.col("_n") * midpoint).cast("int") - n // 2, F.col("_n") - n))
    placed = ranked(scores, by, score, order, name="place").withColumn("place", F.col("place") - 1)
    return placed.join(total, by).where((F.col("place") >= first) & (F.col("place") < first + n)).drop("_n")


def noise_floor_frames(scores: DataFrame, chosen: DataFrame, by: str, part: float = 0.25, score: str = "score", order: str = "frame_id") -> DataFrame:
    """The worst part of each file's frames, without those chosen."""
    n = scores.groupBy(by).agg(F.count("*").alias("_n"))
    worst = ranked(scores, by, score, order, name="_p").join(n, by).where(F.col("_p") <= F.floor(F.col("_n") * part)).drop("_p", "_n")
    return worst.join(chosen.select(by, order), [by, order], "left_anti")


def per_ap_top(scores: DataFrame, by: list[str], part: float, order: str = "frame_id") -> DataFrame:
    """The best frames of each alignment point: the part of them, three at least. Points are few, so they are ranked by ranges (ranked)."""
    n = scores.groupBy(*by).agg(F.count("*").alias("_n"))
    return ranked(scores, by, F.desc("score"), order, name="place").join(n, by).where(F.col("place") <= F.greatest(F.lit(3), F.floor(F.col("_n") * part))).drop("_n")


def covered(points: DataFrame) -> DataFrame:
    """(ax, ay, size, y, x): the pixels that each point's patch covers, made in tasks. Spark broadcasts them or not by their size."""
    half = F.expr("size div 2").cast("int")
    rows = points.withColumn("y", F.explode(F.sequence(F.col("ay") - half, F.col("ay") + half - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.col("ax") - half, F.col("ax") + half - 1)))


def derotation_field(x: Column, y: Column, cx: float, cy: float, radius: float, ratio: float, delta: Column, pole: Column, scale: float = 0.8, tilted: bool = False) -> Column:
    """STRUCT(dx, dy): the drift of an oblate disk that has turned by delta degrees, along the pole's direction; if tilted, the flattening turns with the pole too."""
    rx, ry = x - cx, y - cy
    if tilted:
        c, s = F.cos(F.radians(pole)), F.sin(F.radians(pole))
        rx, ry = rx * c + ry * s, ry * c - rx * s
    depth2 = F.lit((1.05 * radius) ** 2) - F.pow(rx, F.lit(2)) - F.pow(ry / ratio, F.lit(2))
    drift = scale * F.radians(delta) * F.sqrt(F.greatest(F.lit(0.0), depth2))
    return F.struct((drift * F.cos(F.radians(pole))).alias("dx"), (drift * F.sin(F.radians(pole))).alias("dy"))


def rotation_delta(dt: Column, period_hours: float) -> Column:
    """Degrees that a body turns in dt seconds."""
    return dt / (period_hours * 3600) * 360


def limb_shift(cx: Column, cy: Column, radius: Column, ref_cx: float, ref_cy: float) -> Column:
    """STRUCT(dx, dy) from a disk's centre to the reference's; zero where the disk is under 5 pixels or the shift over 15."""
    dx, dy = ref_cx - cx, ref_cy - cy
    off = (radius < 5) | (F.abs(dx) > 15) | (F.abs(dy) > 15)
    return F.struct(F.when(off, 0.0).otherwise(dx).alias("dx"), F.when(off, 0.0).otherwise(dy).alias("dy"))


def gated(conf: Column, dx: Column, dy: Column, least: float = 0.15, most: float = 20.0) -> Column:
    """Whether a shift is trusted."""
    return (conf >= least) & (F.sqrt(dx * dx + dy * dy) <= most)


def pole_angle(times: DataFrame, ephemeris: DataFrame, body: str) -> DataFrame:
    """Adds pole: the body's angle between its day and the next by minute of day, the short way round; that of the day without a next one; 0 without the body.

    The ephemeris has a row a day, so it is small, and Spark broadcasts it by its size.
    """
    own = ephemeris.where(F.col("body") == body).select("date", F.col("angle").alias("_v0"))
    following = own.select(F.date_sub("date", 1).alias("date"), F.col("_v0").alias("_v1"))
    rows = times.withColumn("date", F.to_date("ts")).join(own, "date", "left").join(following, "date", "left")
    part = (F.hour("ts") * 60 + F.minute("ts")) / 1440.0
    turn = F.pmod(F.col("_v1") - F.col("_v0") + 180.0, F.lit(360.0)) - 180.0
    angle = F.when(F.col("_v0").isNull(), 0.0).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(F.pmod(F.col("_v0") + part * turn, F.lit(360.0)))
    return rows.withColumn("pole", angle).drop("date", "_v0", "_v1")


def shared_center(centers: DataFrame, by: str, h: int, w: int) -> DataFrame:
    """(by, dx, dy): the shift of one filter's centre to the frame's centre for all filters of a group; IR, R, G, CH4, B in this order."""
    order = F.array_position(F.array(*[F.lit(f) for f in ("IR", "R", "G", "CH4", "B")]), F.col("filter"))
    best = centers.where(order > 0).groupBy(by).agg(F.min_by(F.struct("cx", "cy"), F.struct(order, F.col("frame_id"))).alias("c"))
    return best.select(by, (w / 2 - F.col("c.cx")).alias("dx"), (h / 2 - F.col("c.cy")).alias("dy"))


def smooth_centers(centers: DataFrame, by: str) -> DataFrame:
    """Adds dx, dy: from each centre to the median of five in order of time; 0 under 0.05."""
    five = Window.partitionBy(by).orderBy("ts", "frame_id").rowsBetween(-2, 2)

    def move(c: str) -> Column:
        d = F.percentile(c, F.lit(0.5)).over(five) - F.col(c)
        return F.when(F.abs(d) < 0.05, 0.0).otherwise(d)

    return centers.withColumn("dx", move("cx")).withColumn("dy", move("cy"))


def aligned(limb: Column, phase: Column) -> Column:
    """STRUCT(dx, dy, method): the limb's shift, or the phase shift where that is zero."""
    failed = (limb["dx"] == 0) & (limb["dy"] == 0)
    return F.when(failed, F.struct(phase["dx"].alias("dx"), phase["dy"].alias("dy"), F.lit("phase").alias("method"))).otherwise(F.struct(limb["dx"].alias("dx"), limb["dy"].alias("dy"), F.lit("limb").alias("method")))
