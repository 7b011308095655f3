"""Queries over run logs: written as JSON by window, read back, and put into tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.operators import alignment, derotate, logs, sequence
from lumastack.plans import alignment_queries as aq
from lumastack.plans import frame_queries as fq
from lumastack.plans.register import registrar
from lumastack.sources.shared import materialise, shared_dir

QUERIES, ORACLE_SQL, query = registrar()
LOW, HIGH = 0.01, 0.99


def stored(spark, rows: DataFrame, by: str, columns: str) -> DataFrame:
    """rows written as a log by window and read back."""
    path = f"{shared_dir(spark)}/logs/{uuid.uuid4().hex}"
    logs.write_log(rows, path, by)
    return logs.read_log(spark, path, f"{by} {dict(rows.dtypes)[by]}", columns)


def gains(spark, sf) -> DataFrame:
    return fq.auto_saturate(spark, sf)


def composite_logs(spark, sf, mode: str, shifts: DataFrame | None = None) -> DataFrame:
    """The log of all composites of all files, by way of JSON files."""
    channels = materialise(alignment.as_frames(fq.channels(spark, sf), "file_id", "filter"))
    found = logs.composite_shifts(channels, "file_id") if shifts is None else shifts
    made = logs.composite_log(logs.stretch_limits(channels, "file_id", mode, LOW, HIGH), found, gains(spark, sf), "file_id", mode)
    return stored(spark, made, "file_id", logs.COMPOSITE)


GAIN_SQL = fq.ORACLE_SQL["auto_saturate"].removeprefix("WITH ")
GAIN_SQL = GAIN_SQL[: GAIN_SQL.rindex(" SELECT")] + ", gains AS (" + GAIN_SQL[GAIN_SQL.rindex("SELECT") :] + ")"


@query(f"""WITH {GAIN_SQL}, c AS (SELECT file_id, name, filter, role, v FROM ch JOIN spec USING (filter) JOIN ok USING (file_id, name)),
own AS (SELECT file_id, name, filter, role, quantile_cont(v, {LOW}) AS lo, quantile_cont(v, {HIGH}) AS hi FROM c GROUP BY ALL),
joint AS (SELECT file_id, name, quantile_cont(v, {LOW}) AS lo, quantile_cont(v, {HIGH}) AS hi FROM c WHERE role <> 'L' GROUP BY ALL)
SELECT file_id, name, CASE WHEN name = 'IR-RGB' THEN 'LRGB' ELSE 'RGB' END AS type, 'joint' AS color_stretch_mode, filter, role, CASE role WHEN 'L' THEN 'independent' ELSE 'joint' END AS mode,
       round(CASE role WHEN 'L' THEN own.lo ELSE joint.lo END, 5) AS plow, round(CASE role WHEN 'L' THEN own.hi ELSE joint.hi END, 5) AS phigh, round(gain, 4) AS saturation_gain
FROM own JOIN joint USING (file_id, name) JOIN gains USING (file_id, name)""")
def composite_log_sink(spark, sf):
    """The composites' log as it is read back: a row for each channel, with the limits of its stretch and the composite's saturation gain."""
    log = composite_logs(spark, sf, "joint")
    flat = log.select("file_id", "name", "type", "color_stretch_mode", "saturation_gain", "channels", F.explode("stretch").alias("filter", "s"))
    role = F.filter(F.map_keys("channels"), lambda r: F.col("channels")[r] == F.col("filter"))[0]
    return flat.select("file_id", "name", "type", "color_stretch_mode", "filter", role.alias("role"), "s.mode", "s.plow", "s.phigh", "saturation_gain")


@query(f"""WITH {fq.STACKED_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY file_id, filter) AS n FROM k WHERE kept)
SELECT file_id, filter, n AS n_stacked, frame_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, round(score, 4) AS norm_score, round(epoch(ts) - c, 2) AS dt_sec, round((epoch(ts) - c) / (9.9281 * 3600) * 360, 4) AS delta_lambda_deg, row_number() OVER (PARTITION BY file_id, filter ORDER BY abs(epoch(ts) - c), ts, frame_id) = 1 AS is_reference FROM t""")
def derotation_log_sink(spark, sf):
    """The log of the de-rotated stacks as it is read back, a row for each frame: what can be said of it without resampling."""
    log = derotation_logs(spark, sf).select("file_id", "filter", "n_stacked", F.explode("frames").alias("f"))
    return log.select("file_id", "filter", "n_stacked", *[f"f.{c}" for c in ("frame_id", "timestamp", "norm_score", "dt_sec", "delta_lambda_deg", "is_reference")])


def derotation_logs(spark, sf) -> DataFrame:
    _, log = derotate.derotate_stack(fq.timed_frames(spark, sf), ["file_id", "filter"], "center_s", "pole", 0.3)
    return stored(spark, logs.derotation_log(log, ["file_id", "filter"]), "file_id", logs.DEROTATION)


@query(f"""WITH {fq.STACKED_SQL} SELECT file_id, filter, count(*) FILTER (kept) AS n_included, count(*) AS n_total, avg(score) FILTER (kept) AS quality_post,
  1 / (1 + CASE WHEN avg(score) FILTER (kept) <= 1e-9 THEN 1.0 ELSE stddev_pop(score) FILTER (kept) / avg(score) FILTER (kept) END) AS stability, count(*) FILTER (kept) AS n_stacked FROM k GROUP BY file_id, filter""")
def filter_stats_log(spark, sf):
    """Figures of each file and filter beside what the de-rotation's log on disk says was stacked."""
    by = ["file_id", "filter"]
    scored = fq.timed_frames(spark, sf).select(*by, "frame_id", "score")
    kept = derotate.over_threshold(scored, by, 0.3, "score").select("frame_id", F.lit(True).alias("included"))
    marked = scored.join(kept, "frame_id", "left").withColumn("included", F.coalesce("included", F.lit(False)))
    return logs.stack_stats(marked, derotation_logs(spark, sf), by)


@query(aq.ORACLE_SQL["series_frame_log"].replace("sum(weight * dt) AS avg_dt_sec", "round(sum(weight * dt), 1) AS avg_dt_sec, list(round(score, 3) ORDER BY ts, frame_id) AS scores"))
def series_log_sink(spark, sf):
    """The series' log as it is read back; a folder holds fifty cycles."""
    f = aq.scored_frames(spark, sf).withColumnRenamed("frame_id", "stem")
    rows = sequence.frame_log(sequence.members(f.select("stem", "ts", "filter"), aq.FRAME_CYCLE, aq.FRAME_SPAN, None, f, aq.WEAK))
    made = rows.withColumn("cycle_id", F.col("cycle_id").cast("bigint")).withColumn("part", F.floor(F.col("cycle_id") / 50))
    return stored(spark, made, "part", logs.SERIES).drop("part")


def centroid_shifts(spark, sf) -> DataFrame:
    """(file_id, name, filter, dx, dy): how far each channel's centre of gravity lies from that of the composite's reference."""
    v, specs = F.col("v"), logs.spec_channels(spark)
    c = fq.channels(spark, sf).groupBy("file_id", "filter").agg((F.sum(F.col("x") * v) / F.sum(v)).alias("cx"), (F.sum(F.col("y") * v) / F.sum(v)).alias("cy"))
    own = c.join(F.broadcast(specs), "filter")
    ref = c.select("file_id", F.col("filter").alias("reference"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    return own.where("filter <> reference").join(ref, ["file_id", "reference"]).select("file_id", "name", "filter", (F.col("cx") - F.col("rx")).alias("dx"), (F.col("cy") - F.col("ry")).alias("dy"))


@query(f"""WITH {GAIN_SQL}, m AS (SELECT file_id, filter, sum(x * v) / sum(v) AS cx, sum(y * v) / sum(v) AS cy FROM ch GROUP BY ALL), refs AS (SELECT * FROM (VALUES ('RGB', 'R'), ('IR-RGB', 'IR'), ('CH4-G-IR', 'IR')) t(name, ref)),
s AS (SELECT m.file_id, name, filter, role, round(m.cx - r.cx, 3) AS dx, round(m.cy - r.cy, 3) AS dy FROM m JOIN spec USING (filter) JOIN ok USING (file_id, name) JOIN refs USING (name) JOIN m r ON r.file_id = m.file_id AND r.filter = ref),
cells AS (SELECT file_id, filter, name, '[' || role || '] ' || CASE WHEN abs(dx) < 0.05 AND abs(dy) < 0.05 THEN 'ref' ELSE printf('%+.1f,%+.1f', dx, dy) END AS cell FROM s UNION ALL SELECT file_id, 'Sat', name, printf('%.2f', round(gain, 4)) || '×' FROM gains)
SELECT file_id, filter, coalesce(max(cell) FILTER (name = 'RGB'), '—') AS "RGB", coalesce(max(cell) FILTER (name = 'IR-RGB'), '—') AS "IR-RGB", coalesce(max(cell) FILTER (name = 'CH4-G-IR'), '—') AS "CH4-G-IR" FROM cells GROUP BY file_id, filter""")
def role_table(spark, sf):
    """Each filter's role and shift in each composite, and the saturation gains, from the log on disk; shifts are those of centres of gravity."""
    return logs.role_table(composite_logs(spark, sf, "joint", centroid_shifts(spark, sf)), "file_id")
