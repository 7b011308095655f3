"""Run logs: what a composite, a de-rotated stack or a frame of a series was made of, as tables, as JSON by window, and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumastack.operators import kernels
from lumastack.operators.frames import per_stack
from lumastack.operators.report import SPECS, spec_rows

#: The filters in the order in which a composite without L takes its reference.
REFERENCE_ORDER = ("IR", "R", "G", "B", "CH4")
#: Columns of a log beside the window's own, as they are written and read.
COMPOSITE = "name string, type string, color_stretch_mode string, channels map<string,string>, stretch map<string,struct<mode:string,plow:double,phigh:double>>, alignment map<string,array<double>>, saturation_gain double"
DEROTATION = "filter string, n_stacked bigint, frames array<struct<frame_id:bigint,timestamp:string,norm_score:double,dt_sec:double,disk_center_px:array<double>,disk_radius_px:double,delta_lambda_deg:double,align_shift_px:array<double>,align_method:string,is_reference:boolean>>"
SERIES = "cycle_id bigint, filter string, n_used bigint, n_below bigint, avg_dt_sec double, scores array<double>"


def reference_of(name: str) -> str:
    """The filter that a composite's channels are aligned to: its L, or else the first of REFERENCE_ORDER that it has."""
    roles = SPECS[name]
    return roles.get("L") or next(f for f in REFERENCE_ORDER if f in roles.values())


def spec_channels(spark: SparkSession) -> DataFrame:
    """(name, filter, role, role_order, reference): a dozen rows; a filter with several roles in a composite has its first one."""
    rows = spec_rows(spark).groupBy("name", "filter").agg(F.min_by("role", "role_order").alias("role"), F.min("role_order").alias("role_order"))
    return rows.withColumn("reference", F.coalesce(*[F.when(F.col("name") == n, F.lit(reference_of(n))) for n in SPECS]))


def whole_composites(channels: DataFrame, by: str) -> DataFrame:
    """(by, name): the composites of which a group has all filters."""
    specs = spec_channels(channels.sparkSession)
    need = specs.groupBy("name").agg(F.count("*").alias("_need"))
    have = channels.select(by, "filter").distinct().join(F.broadcast(specs.select("name", "filter")), "filter").groupBy(by, "name").agg(F.count("*").alias("_have"))
    return have.join(F.broadcast(need), "name").where("_have = _need").select(by, "name")


def composite_shifts(channels: DataFrame, by: str, most: float = 20.0) -> DataFrame:
    """(by, name, filter, dx, dy): how much each channel (by, filter, h, w, px) of each whole composite is displaced against the composite's
    reference, which has no row; 0, 0 where either is over `most`."""
    specs = spec_channels(channels.sparkSession)
    own = channels.join(F.broadcast(specs), "filter").join(whole_composites(channels, by), [by, "name"])
    refs = own.where(F.col("filter") == F.col("reference")).select(by, "name", F.col("px").alias("_ref"))
    rows = own.where(F.col("filter") != F.col("reference")).select(by, "name", "filter", "h", "w", "px").join(refs, [by, "name"]).where(F.size("_ref") == F.size("px"))

    def kernel(a, table):
        ref = table.column("_ref").flatten().to_numpy(zero_copy_only=False).reshape(a.shape)
        s = np.array([kernels.phase_shift(r, f[None])[0, :2] for f, r in zip(a, ref, strict=True)])
        s = np.where(np.abs(s).max(1, keepdims=True) > most, 0.0, s)
        return {"dx": s[:, 0], "dy": s[:, 1]}

    return per_stack(rows, kernel, "dx double, dy double", (by, "name", "filter", "_ref")).drop("_ref")


def stretch_limits(channels: DataFrame, by: str, mode: str, low: float, high: float) -> DataFrame:
    """(by, name, filter, mode, plow, phigh): the percentiles that each channel (by, filter, px) of each whole composite is stretched between.

    Mode `independent`: the channel's own; `joint`: those of a composite's colours together, L its own; `none`: none at all. A row holds
    the pixels of the one to three frames that share limits.
    """
    specs = spec_channels(channels.sparkSession)
    own = channels.join(F.broadcast(specs), "filter").join(whole_composites(channels, by), [by, "name"])
    if mode == "none":
        null = F.lit(None).cast("double")
        return own.select(by, "name", "filter", F.lit("none").alias("mode"), null.alias("plow"), null.alias("phigh"))
    if mode not in ("independent", "joint"):
        raise ValueError(f"no stretch mode {mode}")
    alone = (F.col("role") == "L") | F.lit(mode == "independent")
    rows = own.withColumn("mode", F.when(alone, "independent").otherwise("joint")).withColumn("_set", F.when(alone, F.col("filter")))
    values = rows.groupBy(by, "name", "_set").agg(F.array_sort(F.flatten(F.collect_list("px"))).alias("_v"), F.collect_list(F.struct("filter", "mode")).alias("_f"))

    def at(part: float) -> Column:
        place = (F.size("_v") - 1) * F.lit(part)
        a, b = (F.get("_v", end(place).cast("int")) for end in (F.floor, F.ceil))
        return a + (b - a) * (place - F.floor(place))

    return values.select(by, "name", F.explode("_f").alias("_c"), at(low).alias("plow"), at(high).alias("phigh")).select(by, "name", "_c.filter", "_c.mode", "plow", "phigh")


def composite_log(limits: DataFrame, shifts: DataFrame, gains: DataFrame, by: str, mode: str) -> DataFrame:
    """(by, COMPOSITE): a row for each group and composite, from stretch_limits, composite_shifts (by, name, filter, dx, dy) and gains (by, name, gain).

    Limits are rounded to 5 digits, shifts to 3, the gain to 4; a composite without a gain has none, a reference without a shift 0, 0.
    """
    specs = spec_rows(limits.sparkSession)
    roles = specs.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("role", "filter"))).alias("channels"))
    stretch = F.struct("mode", F.round("plow", 5).alias("plow"), F.round("phigh", 5).alias("phigh"))
    zero = F.coalesce(F.round("dx", 3), F.lit(0.0)), F.coalesce(F.round("dy", 3), F.lit(0.0))
    rows = limits.join(shifts.select(by, "name", "filter", "dx", "dy"), [by, "name", "filter"], "left")
    g = rows.groupBy(by, "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("filter", stretch)))).alias("stretch"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("filter", F.array(*zero))))).alias("alignment"))
    g = g.join(F.broadcast(roles), "name").join(gains.select(by, "name", F.round("gain", 4).alias("saturation_gain")), [by, "name"], "left")
    kind = F.when(F.map_contains_key("channels", F.lit("L")), "LRGB").otherwise("RGB")
    return g.select(by, "name", kind.alias("type"), F.lit(mode).alias("color_stretch_mode"), "channels", "stretch", "alignment", "saturation_gain")


def derotation_log(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_stacked, frames): a row for each stack from the log of derotate_stack; its frames in order of time, then id."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kept = ("norm_score", "dt_sec", "disk_center_px", "disk_radius_px", "delta_lambda_deg", "align_shift_px", "align_method", "is_reference")
    frame = F.struct("ts", F.col("frame_id").cast("bigint").alias("frame_id"), stamp.alias("timestamp"), *kept)
    g = log.groupBy(*by).agg(F.count("*").alias("n_stacked"), F.array_sort(F.collect_list(frame)).alias("_f"))
    return g.select(*by, "n_stacked", F.transform("_f", lambda f: F.struct(f["frame_id"].alias("frame_id"), f["timestamp"].alias("timestamp"), *[f[c].alias(c) for c in kept])).alias("frames"))


def write_log(rows: DataFrame, path: str, by: str) -> None:
    """rows as JSON lines in a folder by=value for each window (or day): a window's rows go through one task, and are one file."""
    rows.repartition(by).write.partitionBy(by).json(path, ignoreNullFields=False)


def read_log(spark: SparkSession, path: str, by: str, columns: str) -> DataFrame:
    """A log that write_log has written; by: name and type of the window's column. No row is read to find types."""
    return spark.read.schema(f"{columns}, {by}").json(path)


def stack_stats(scores: DataFrame, log: DataFrame, by: list[str], expected: float | None = None) -> DataFrame:
    """(by, n_included, n_total, quality_post, stability, n_stacked): figures of scored frames (by, score, included) beside the number that the
    de-rotation log (derotation_log) says were stacked; null where it has no such stack."""
    kept = F.when(F.col("included"), F.col("score"))
    g = scores.groupBy(*by).agg(F.count(kept).alias("n_included"), F.count("*").alias("n_total"), F.avg(kept).alias("quality_post"), F.stddev_pop(kept).alias("_s"))
    cv = F.when(F.col("quality_post") <= 1e-9, 1.0).otherwise(F.try_divide(F.col("_s"), F.col("quality_post")))
    return g.withColumn("stability", 1 / (1 + cv)).drop("_s").join(log.select(*by, "n_stacked"), by, "left")


def role_table(logs: DataFrame, by: str) -> DataFrame:
    """(by, filter, a column for each composite): the role that a filter has in a composite and its shift there, from composite_log:
    `[R] +0.3,-0.1`, `[L] ref` under 0.05 in both, a dash where it has none; and a row `Sat` with the saturation gains, if a group has any."""
    dx, dy = F.col("alignment")[F.col("filter")][0], F.col("alignment")[F.col("filter")][1]
    near = dx.isNull() | ((F.abs(dx) < 0.05) & (F.abs(dy) < 0.05))
    cell = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.when(near, "ref").otherwise(F.format_string("%+.1f,%+.1f", dx, dy)))
    specs = spec_channels(logs.sparkSession).select("name", "filter", "role")
    cells = logs.select(by, "name", "alignment").join(F.broadcast(specs), "name").select(by, "filter", "name", cell.alias("cell"))
    gains = logs.where(F.col("saturation_gain") > 0).select(by, F.lit("Sat").alias("filter"), "name", F.format_string("%.2f×", "saturation_gain").alias("cell"))
    wide = cells.unionByName(gains).groupBy(by, "filter").pivot("name", list(SPECS)).agg(F.max("cell"))
    return wide.select(by, "filter", *[F.coalesce(F.col(f"`{n}`"), F.lit("—")).alias(n) for n in SPECS])
