"""The given tables as captures, frames and file names.

`events` stands for a capture log, `embeddings` for small frames, and file names are built from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = {"view": "IR", "click": "R", "purchase": "G", "signup": "B", "error": "CH4"}
BANDS = ["IR", "R", "G", "B", "CH4"]
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, ts, filter, session, raw_score)."""
    kinds = F.create_map(*[F.lit(x) for pair in FILTERS.items() for x in pair])
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("stem"), "ts", kinds[F.col("event_type")].alias("filter"), F.col("user_id").alias("session"), F.col("value").alias("raw_score"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, file_id, filter, ts, h, w, px)."""
    return frames_of(table(spark, sf_dir, "embeddings"))


def frames_of(rows: DataFrame) -> DataFrame:
    """The same from rows of that table, a stream of them too."""
    bands = F.array(*[F.lit(b) for b in BANDS])
    px = F.transform(F.col("embedding").cast("array<double>"), lambda v: (v + 1) / 2)
    ts = F.timestamp_seconds(F.lit(1704067200) + 45 * F.col("vec_id")).cast("timestamp_ntz")
    return rows.select(F.col("vec_id").alias("frame_id"), F.col("label").alias("file_id"), F.element_at(bands, (F.col("vec_id") % 5 + 1).cast("int")).alias("filter"), ts.alias("ts"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), px.alias("px"))


def pixels(frames_: DataFrame) -> DataFrame:
    """One row per pixel: the frame's columns but px, y, x, v."""
    keep = [c for c in frames_.columns if c != "px"]
    return frames_.select(*keep, F.posexplode("px").alias("pos", "v")).select(*keep, F.expr("cast(pos div w as int)").alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, path, modified): the three naming conventions and names that fit none."""
    t, i = F.col("ts"), F.col("event_id")
    kinds = F.create_map(*[F.lit(x) for pair in FILTERS.items() for x in pair])
    clock = F.concat(F.date_format(t, "yyyy-MM-dd-HHmm"), F.lit("_"), F.expr("cast(second(ts) div 6 as string)"))
    name = (
        F.when(i % 4 == 0, F.concat(F.lit("/data/"), clock, F.lit("-U-"), kinds[F.col("event_type")], F.lit("-Jup_stack.tif")))
        .when(i % 4 == 1, F.concat(F.lit("/data/Saturn_"), F.date_format(t, "yyyyMMdd-HHmmss"), F.lit("_ap47.tif")))
        .when(i % 4 == 2, F.concat(F.lit("/data/"), F.date_format(t, "yyyy-MM-dd"), F.when(i % 8 == 2, "/Mars/").otherwise("/misc/"), F.date_format(t, "HH_mm_ss"), F.lit("_conv.tif")))
        .otherwise(F.concat(F.lit("/data/notes"), i.cast("string"), F.lit(".tif")))
    )
    return table(spark, sf_dir, "events").select(i, name.alias("path"), t.alias("modified"))


#: The same as DuckDB SQL, for the queries' reference results.
CAPTURES_SQL = "captures AS (SELECT CAST(event_id AS VARCHAR) AS stem, ts, CASE event_type WHEN 'view' THEN 'IR' WHEN 'click' THEN 'R' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'B' WHEN 'error' THEN 'CH4' END AS filter, user_id AS session, value AS raw_score, epoch_us(ts) / 1e6 AS s FROM events)"
FRAMES_SQL = "frames AS (SELECT vec_id AS frame_id, label AS file_id, (['IR','R','G','B','CH4'])[vec_id % 5 + 1] AS filter, TIMESTAMP '2024-01-01' + to_seconds(45 * vec_id) AS ts, embedding FROM embeddings)"
PIXELS_SQL = FRAMES_SQL + ", pixels AS (SELECT frame_id, file_id, filter, ts, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, (CAST(embedding[i + 1] AS DOUBLE) + 1) / 2 AS v FROM frames, range(64) r(i))"
PATHS_SQL = """paths AS (SELECT event_id, ts AS modified, CASE event_id % 4
 WHEN 0 THEN '/data/' || strftime(ts, '%Y-%m-%d-%H%M') || '_' || CAST(CAST(second(ts) AS INTEGER) // 6 AS VARCHAR) || '-U-' || CASE event_type WHEN 'view' THEN 'IR' WHEN 'click' THEN 'R' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'B' ELSE 'CH4' END || '-Jup_stack.tif'
 WHEN 1 THEN '/data/Saturn_' || strftime(ts, '%Y%m%d-%H%M%S') || '_ap47.tif'
 WHEN 2 THEN '/data/' || strftime(ts, '%Y-%m-%d') || CASE WHEN event_id % 8 = 2 THEN '/Mars/' ELSE '/misc/' END || strftime(ts, '%H_%M_%S') || '_conv.tif'
 ELSE '/data/notes' || CAST(event_id AS VARCHAR) || '.tif' END AS path, second(ts) AS ss FROM events)"""
