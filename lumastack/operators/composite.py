"""Channels to colour, tone and normalisation, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumastack.operators.report import SPECS, spec_rows
from lumastack.operators.stack import clip01
from lumastack.operators.windows import percentiles


def compose_rgb(pixels: DataFrame, by: str) -> DataFrame:
    """(by, name, y, x, R, G, B[, L]) for every composite spec of which a group has all filters."""
    specs = spec_rows(pixels.sparkSession)
    need = specs.groupBy("name").agg(F.count("*").alias("_need"))
    have = pixels.select(by, "filter").distinct().join(F.broadcast(specs), "filter").groupBy(by, "name").agg(F.count("*").alias("_have"))
    whole = have.join(F.broadcast(need), "name").where("_have = _need").select(by, "name")
    roles = pixels.join(F.broadcast(specs), "filter").join(whole, [by, "name"])
    return roles.groupBy(by, "name", "y", "x").pivot("role", ["R", "G", "B", "L"]).agg(F.avg("v"))


def skipped(pixels: DataFrame, by: str) -> DataFrame:
    """(by, name, missing): specs that a group lacks filters for."""
    specs = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f).alias("filter")) for name, roles in SPECS.items() for f in roles.values()])
    own = pixels.select(by, "filter").distinct()
    wanted = own.select(by).distinct().select(by, F.explode(specs).alias("s")).select(by, "s.*")
    return wanted.join(own, [by, "filter"], "left_anti").groupBy(by, "name").agg(F.array_sort(F.collect_set("filter")).alias("missing"))


def stretch(v: Column, low: Column, high: Column, top: float = 1.0, flat: Column | float = 0.0) -> Column:
    """v from low..high to 0..top, clipped; where high is not over low, `flat`."""
    return F.when(high > low, clip01((v - low) / (high - low)) * top).otherwise(flat)


def stretched(pixels: DataFrame, by: list[str], low: float = 0.001, high: float = 0.999, top: float = 1.0, *, joint: bool = False) -> DataFrame:
    """Adds out: percentiles of each group (joint: by the first column alone) stretched to 0..top; flat groups are 0 (joint: a span of 1).

    A joint group may be of any size, so its percentiles come from ranks over all tasks.
    """
    keys = by[:1] if joint else by
    p = percentiles(pixels, keys[0], "v", _lo=low, _hi=high) if joint else pixels.groupBy(*keys).agg(F.percentile("v", F.lit(low)).alias("_lo"), F.percentile("v", F.lit(high)).alias("_hi"))
    flat = clip01(F.col("v") - F.col("_lo")) * top if joint else F.lit(0.0)
    return pixels.join(p, keys).withColumn("out", stretch(F.col("v"), F.col("_lo"), F.col("_hi"), top, flat)).drop("_lo", "_hi")


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """STRUCT(l, a, b) of sRGB in 0..1 under D65."""
    lin = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in (r, g, b)]
    rows = ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754))
    xyz = [(m[0] * lin[0] + m[1] * lin[1] + m[2] * lin[2]) / m[3] for m in rows]
    f = [F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116) for t in xyz]
    light = F.when(xyz[1] > 0.008856, 116 * F.cbrt(xyz[1]) - 16).otherwise(903.3 * xyz[1])
    return F.struct(light.alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def lab_to_rgb(light: Column, a: Column, b: Column) -> Column:
    """STRUCT(r, g, b), clipped to 0..1."""
    fy = (light + 16) / 116.0
    y = F.when(light > 7.9996, fy * fy * fy).otherwise(light / 903.3)
    fy = F.when(light > 7.9996, fy).otherwise(7.787 * y + 16.0 / 116)

    def back(f: Column) -> Column:
        return F.when(f > 0.206893, f * f * f).otherwise((f - 16.0 / 116) / 7.787)

    x, z = back(fy + a / 500.0) * 0.950456, back(fy - b / 200.0) * 1.088754
    rows = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
    lin = [m[0] * x + m[1] * y + m[2] * z for m in rows]
    out = [F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c) for c in lin]
    return F.struct(*[clip01(c).alias(n) for c, n in zip(out, "rgb", strict=True)])


def compose_lrgb(composites: DataFrame, weight: float = 1.0) -> DataFrame:
    """Composites that have L: lightness mixed with L by weight, in Lab."""
    lab = composites.where(F.col("L").isNotNull()).withColumn("_lab", rgb_to_lab(F.col("R"), F.col("G"), F.col("B")))
    light = weight * F.col("L") * 100 + (1 - weight) * F.col("_lab.l")
    keep = [c for c in composites.columns if c not in ("R", "G", "B", "L")]
    return lab.withColumn("_rgb", lab_to_rgb(light, F.col("_lab.a"), F.col("_lab.b"))).select(*keep, F.col("_rgb.r").alias("R"), F.col("_rgb.g").alias("G"), F.col("_rgb.b").alias("B"))


def limb_desaturate(a: Column, x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    """A chroma value faded by a cosine from 0.89 of the radius over 0.15 of it."""
    t = clip01((F.sqrt(F.pow(x - cx, F.lit(2)) + F.pow(y - cy, F.lit(2))) - 0.89 * radius) / (0.15 * radius))
    return a * 0.5 * (1 + F.cos(t * 3.141592653589793))


def saturation_gain(lab: DataFrame, by: list[str], headroom: float = 0.9) -> DataFrame:
    """(by, gain): 127 headroom over the 99.5th percentile of chroma, in 1..2; 1 where that is under 0.001."""
    chroma = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    p = lab.groupBy(*by).agg(F.percentile(chroma, F.lit(0.995)).alias("_p"))
    return p.select(*by, F.when(F.col("_p") < 1e-3, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(2.0), F.try_divide(F.lit(127.0 * headroom), F.col("_p"))))).alias("gain"))


def normalise_windows(pixels: DataFrame, window: str, spec: str) -> DataFrame:
    """Adds out: each window's pixels scaled to the mean of all windows' means of its spec, if it has more than one."""
    means = pixels.groupBy(window, spec).agg(F.avg("v").alias("_m"))
    goal = means.groupBy(spec).agg(F.avg("_m").alias("_g"), F.count("*").alias("_n"))
    factor = F.when((F.col("_n") > 1) & (F.col("_m") > 1e-9), F.try_divide("_g", "_m")).otherwise(1.0)
    return pixels.join(means, [window, spec]).join(goal, spec).withColumn("out", clip01(F.col("v") * factor)).drop("_m", "_g", "_n")


def white_balance(composites: DataFrame, by: list[str]) -> DataFrame:
    """(by, gain_r, gain_b): medians of green over red and over blue, in 0.5..3."""
    m = composites.groupBy(*by).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_{c}") for c in "RGB"])
    gain = [F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.coalesce(F.try_divide(F.col("_G"), F.col(f"_{c}")), F.lit(1.0)))) for c in "RB"]
    return m.select(*by, gain[0].alias("gain_r"), gain[1].alias("gain_b"))


def levels_adjust(v: Column, black: float, white: float, gamma: float) -> Column:
    """black..white to 0..1, then to the power 1 / gamma."""
    return F.pow(clip01((v - black) / max(white - black, 1e-6)), F.lit(1 / gamma))


def border_taper(x: Column, y: Column, h: int, w: int, width: int) -> Column:
    """A cosine ramp over `width` pixels from each border."""
    edge = F.least(x, F.lit(w - 1) - x, y, F.lit(h - 1) - y)
    return F.when(edge >= width, 1.0).otherwise(0.5 * (1 - F.cos(3.141592653589793 * edge / width)))


def mad_sigma(details: DataFrame, by: list[str]) -> DataFrame:
    """(by, sigma): noise from the median magnitude of v."""
    return details.groupBy(*by).agg((F.percentile(F.abs("v"), F.lit(0.5)) / 0.6745).alias("sigma"))


def soft_threshold(v: Column, t: Column) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - t, F.lit(0.0))
