"""Tables from run logs: statistics, matrices, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumastack.operators.windows import ranked

#: Composite specs: name, then the filter of each role.
SPECS = {"RGB": {"R": "R", "G": "G", "B": "B"}, "IR-RGB": {"L": "IR", "R": "R", "G": "G", "B": "B"}, "CH4-G-IR": {"R": "CH4", "G": "G", "B": "IR"}}
ROLES = ("L", "R", "G", "B")


def spec_rows(spark) -> DataFrame:
    """(name, role, filter, role_order): the composite specs, a dozen rows."""
    rows = [(name, role, by[role], i) for name, by in SPECS.items() for i, role in enumerate(ROLES) if role in by]
    return spark.createDataFrame(rows, "name string, role string, filter string, role_order int")


def score_rows(scores: DataFrame) -> DataFrame:
    """Score rows as they are exported: rounded."""
    return scores.select("ts", "filter", "stem", F.round("raw_score", 2).alias("raw_score"), F.round("norm_score", 6).alias("norm_score"))


def score_sink(scores: DataFrame, path: str) -> None:
    """CSV of all metrics, rounded as they are exported, its files in order of time and filter."""
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = {"laplacian": 2, "tenengrad": 2, "norm_variance": 6, "raw_score": 4, "norm_score": 6}
    rows = scores.select("ts", "filter", "stem", *[F.round(c, n).alias(c) for c, n in digits.items()])
    rows.repartitionByRange(parts, "ts", "filter").sortWithinPartitions("ts", "filter").write.csv(path, header=True)


def window_sink(windows: DataFrame, nested: DataFrame, path: str) -> None:
    """JSON lines of the chosen windows (with window_index from 1) and their map from filter to figures and captures."""
    windows.join(nested.drop("center_ts"), "window_id").write.json(path)


def present_channels(captures: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted channels that any capture has."""
    return captures.where(F.col("filter").isin(*wanted)).select(F.col("filter").alias("channel")).distinct()


def animation_sequence(frames: DataFrame, by: str) -> DataFrame:
    """The stems of each group in order of time."""
    return frames.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ts", "stem"))).alias("f")).select(by, F.col("f.stem").alias("stems"))


def animation_frames(frames: DataFrame, by: str) -> DataFrame:
    """(by, position from 1, stem): the same as rows, for groups of any size."""
    return ranked(frames, by, "ts", "stem").select(by, F.col("rank").alias("position"), "stem")


def summary_matrix(frames: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """A row for each window, a column for each composite, and how many are missing."""
    wide = frames.groupBy(by).pivot("filter", columns).agg(F.max("stem"))
    return wide.withColumn("missing", F.lit(0).cast("bigint") + sum(F.col(c).isNull().cast("bigint") for c in columns))


def filter_stats(quality: DataFrame, stack_log: DataFrame) -> DataFrame:
    """Figures of each window and filter with the number of frames stacked."""
    return quality.join(stack_log, ["window_id", "filter"], "left").select("window_id", "filter", "n_included", "n_total", "quality_post", "stability", "n_stacked")


def align_table(shifts: DataFrame) -> DataFrame:
    """A row for each filter, a column for each composite: the filter's first role there, and whether it is shifted (`ref` under 0.05)."""
    specs = spec_rows(shifts.sparkSession)
    cell = F.concat(F.min_by("role", "role_order"), F.when(F.abs(F.first("dx")) < 0.05, " ref").otherwise(" shifted"))
    rows = shifts.join(F.broadcast(specs), "filter").groupBy("filter", "name").agg(cell.alias("cell"))
    return rows.groupBy("filter").pivot("name", list(SPECS)).agg(F.max("cell"))


def time_label(s: Column, zone: str) -> Column:
    """Seconds (UTC) as local date and time."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(s), zone), "yyyy-MM-dd HH:mm")


def run_summary(rows: DataFrame, by: list[str], stacked: Column) -> DataFrame:
    """Rows in and stacked and their rate, for each group, with subtotals and the total."""
    n = F.count("*")
    good = F.count(F.when(stacked, 1))
    return rows.rollup(*by).agg(n.alias("n_in"), good.alias("n_stacked"), (good / n).alias("rate"))
