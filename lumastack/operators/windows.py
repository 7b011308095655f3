"""Window search: the best capture windows over all filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumastack.operators.intervals import clipped_windows
from lumastack.sources.shared import materialise


def seconds(ts: Column) -> Column:
    """A timestamp (with or without zone) as seconds, UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def raw_score(laplacian: Column, tenengrad: Column, norm_variance: Column) -> Column:
    """The weighted quality of a capture."""
    return 0.5 * laplacian + 0.3 * tenengrad + 0.2 * norm_variance


def norm_scores(scores: DataFrame, score_col: str = "raw_score", by: str = "filter") -> DataFrame:
    """Adds norm_score: min-max within each filter; 0 where all are equal.

    The range of a filter is aggregated first and joined back (a few rows), since a window over a filter would bring all
    its captures into one task.
    """
    span = scores.groupBy(by).agg(F.min(score_col).alias("_lo"), F.max(score_col).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return scores.join(span, by).withColumn("norm_score", (F.col(score_col) - F.col("_lo")) / width).drop("_lo", "_hi")


def ranked(rows: DataFrame, by: str | list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds rank from 1 within each value of `by` (a column or several), for groups of any size; null is a value.

    Rows are dealt by ranges of (by, order) and stored with their part; a row's rank is its place in its part plus the
    group's rows in earlier parts, which are counted first. So a group that holds most rows is ranked by all tasks.
    """
    by = [by] if isinstance(by, str) else by
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.struct(*by).alias("_group"), F.col("_part").alias("_of"), before.alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    joined = own.join(starts, (F.col("_part") == F.col("_of")) & F.struct(*by).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before", "_group", "_of")


def in_order(rows: DataFrame, order: str, gap: float = float("inf")) -> DataFrame:
    """Adds _place (from 1) and _island (from 0; a new one starts after a step of more than `gap`) over all rows in order of a number.

    Rows are dealt by ranges and stored with their part, so no task has them all. Parts pass on their last value, their rows
    and their gaps; windows over all see a row for each part.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    earlier, own = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_part").orderBy(order)
    ends = dealt.groupBy("_part").agg(F.max(order).alias("_end")).select("_part", F.max("_end").over(earlier).alias("_last"))
    step = F.col(order) - F.coalesce(F.lag(order).over(own), F.col("_last"))
    flagged = dealt.join(ends, "_part").withColumn("_gap", F.coalesce(step > gap, F.lit(False)).cast("bigint")).drop("_last")
    sums = flagged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_gap").alias("_g"))
    sums = sums.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_n", "_g")])
    place = (F.row_number().over(own) + F.col("_before_n")).cast("int")
    return flagged.join(sums, "_part").withColumn("_place", place).withColumn("_island", F.sum("_gap").over(own) + F.col("_before_g")).drop("_part", "_gap", "_before_n", "_before_g")


def percentiles(rows: DataFrame, by: str, value: str, **at: float) -> DataFrame:
    """(by, a column for each name in `at`): exact percentiles of groups of any size, between values as F.percentile has them.

    Equal values are counted first, so one value is a row however often it occurs. These rows are dealt by ranges of (by,
    value) and ranked as in `ranked`; only the two values around each place are kept of a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    dealt = materialise(counts.repartitionByRange(parts, by, value).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(by, "_part").agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(by, "_part", before.alias("_before"), F.sum("_s").over(group).alias("_all"))
    own = dealt.withColumn("_own", F.sum("_n").over(Window.partitionBy("_part", by).orderBy(value)))
    last = F.col("_before") + F.col("_own") - 1
    held = own.join(starts, [by, "_part"]).select(by, value, (last - F.col("_n") + 1).alias("_first"), last.alias("_last"), "_all")

    def place(p: float) -> Column:
        return (F.col("_all") - 1) * F.lit(p)

    def value_at(k: Column) -> Column:
        return F.max(F.when(k.between(F.col("_first"), F.col("_last")), F.col(value)))

    found = held.groupBy(by).agg(F.first("_all").alias("_all"), *[value_at(end(place(p))).alias(f"_{side}_{name}") for name, p in at.items() for side, end in (("low", F.floor), ("high", F.ceil))])
    share = {name: place(p) - F.floor(place(p)) for name, p in at.items()}
    return found.select(by, *[F.when(share[name] == 0, F.col(f"_low_{name}")).otherwise((1 - share[name]) * F.col(f"_low_{name}") + share[name] * F.col(f"_high_{name}")).alias(name) for name in at])


def quality_rank(scores: DataFrame, by: str = "filter") -> DataFrame:
    """Adds rank: 1 is the best of its filter; ties by time, then stem."""
    return ranked(scores, by, F.desc("norm_score"), "ts", "stem")


def min_quality(scores: DataFrame, threshold: float) -> DataFrame:
    """Captures with at least the threshold; an unscored capture counts as 1."""
    return scores.where(F.coalesce("norm_score", F.lit(1.0)) >= threshold)


#: Seconds by which buckets of time reach further than a window, so that no rounding of their bounds loses a member.
SLACK = 1e-3


#: Buckets that half a window is cut into where members are looked up: more of them send anchors more often, and compare fewer in vain.
FINE = 4
#: Tasks for each core that members are looked up in, so that none is left with much more than the others.
TASKS = 16


def buckets(at: Column, half: float, step: float) -> Column:
    """The buckets, `step` long, that have captures or anchors within half a window of a time."""
    return F.explode(F.sequence(F.floor((at - half - SLACK) / step), F.floor((at + half + SLACK) / step)))


def many_tasks(spark: SparkSession) -> int:
    """A number of tasks to ask for where rows are few and what is made of them is not: Spark would join small inputs into a task a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)


def around(captures: DataFrame, anchors: DataFrame, minutes: float, *more: str) -> DataFrame:
    """Members of a window of `minutes` around each anchor (window_id, center_ts, more), both ends included.

    An interval join as an equi-join: time is cut into buckets of an eighth of a window, each anchor looks into the nine or ten buckets
    that its window touches, and the exact ends decide. Anchors are hashed, so that a member is met by those near it without a sort.
    """
    half = minutes * 60.0 / 2
    step, parts = half / FINE, many_tasks(captures.sparkSession)
    member = captures.withColumn("_s", seconds(F.col("ts"))).withColumn("_b", F.floor(F.col("_s") / step)).repartition(parts, "_b")
    centre = anchors.withColumn("_c", seconds(F.col("center_ts"))).withColumn("_b", buckets(F.col("_c"), half, step)).repartition(parts, "_b").hint("shuffle_hash")
    return member.join(centre, "_b").where(F.abs(F.col("_s") - F.col("_c")) <= half).select("window_id", "center_ts", "filter", "stem", "ts", "norm_score", *more)


def anchors_of(captures: DataFrame, anchor: str = "IR") -> DataFrame:
    """(window_id, center_ts): the captures of the anchor filter."""
    return captures.where(F.col("filter") == anchor).select(F.col("stem").alias("window_id"), F.col("ts").alias("center_ts"))


def anchor_windows(captures: DataFrame, minutes: float, anchor: str = "IR") -> DataFrame:
    """Members of a window of `minutes` around each capture of the anchor filter, both ends included."""
    return around(captures, anchors_of(captures, anchor), minutes)


def by_window(found: DataFrame, value: Column, name: str) -> DataFrame:
    """(window_id, _t, a map from filter to a value): a row for each window of clipped_windows; a null filter is the empty one."""
    entry = F.struct(F.coalesce("filter", F.lit("")).alias("filter"), value.alias("value"))
    return found.groupBy("window_id", F.col("c").alias("_t")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def clipped_members(captures: DataFrame, minutes: float, k: float = 1.5, anchor: str = "IR") -> DataFrame:
    """The same rows as sigma_clip(anchor_windows(...)) for k of 0 or more, where a window's best score is always kept.

    The least score kept of each window and filter comes from sums (lumastack.operators.intervals) and goes with the anchor, so members
    are neither shuffled nor sorted by window. Anchors have different stems.
    """
    if k < 0:
        raise ValueError("a window keeps scores under its mean")
    floors = by_window(clipped_windows(captures, anchor, minutes, k), F.col("floor"), "_floors")
    own = anchors_of(captures, anchor).withColumn("_t", F.unix_micros(F.col("center_ts").cast("timestamp"))).withColumn("window_id", F.col("window_id").cast("string"))
    rows = around(captures, own.join(floors, ["window_id", "_t"], "left"), minutes, "_floors")
    return rows.withColumn("included", F.col("norm_score") >= F.col("_floors")[F.coalesce("filter", F.lit(""))]).drop("_floors")


def sigma_clip(members: DataFrame, k: float = 1.5) -> DataFrame:
    """Adds included: a score of at least mean - k standard deviations (population) of its window and filter; the best one if none has that."""
    own = Window.partitionBy("window_id", "filter")
    floor = F.avg("norm_score").over(own) - k * F.stddev_pop("norm_score").over(own)
    kept = members.withColumn("_in", F.col("norm_score") >= floor)
    best = F.row_number().over(own.orderBy(F.desc("norm_score"), "ts", "stem")) == 1
    return kept.withColumn("included", F.col("_in") | (best & ~F.max("_in").over(own))).drop("_in")


def filter_quality(clipped: DataFrame, expected: float) -> DataFrame:
    """(window_id, center_ts, filter, n_total, n_included, quality_pre, quality_post, snr_factor, stability, filter_quality, first_ts, last_ts)."""
    kept = F.when(F.col("included"), F.col("norm_score"))
    g = clipped.groupBy("window_id", "center_ts", "filter").agg(
        F.count("*").alias("n_total"), F.count(kept).alias("n_included"), F.avg("norm_score").alias("quality_pre"), F.avg(kept).alias("quality_post"), F.stddev_pop(kept).alias("_std"),
        F.min(F.when(F.col("included"), F.col("ts"))).alias("first_ts"), F.max(F.when(F.col("included"), F.col("ts"))).alias("last_ts"),
    )
    cv = F.when(F.col("quality_post") <= 1e-9, 1.0).otherwise(F.try_divide(F.col("_std"), F.col("quality_post")))
    g = g.withColumn("snr_factor", F.least(F.lit(1.0), F.sqrt(F.col("n_included") / F.lit(float(expected))))).withColumn("stability", 1 / (1 + cv)).drop("_std")
    return g.withColumn("filter_quality", F.round(F.col("quality_post") * F.col("snr_factor") * F.col("stability"), 4))


def rated_windows(captures: DataFrame, minutes: float, expected: float, k: float = 1.5, anchor: str = "IR") -> DataFrame:
    """The same figures as filter_quality(sigma_clip(anchor_windows(...))), from sums instead of a row for each window and member
    (lumastack.operators.intervals). Captures without a score are in no window."""
    figures = rates(captures.schema["ts"].dataType, expected)
    rows = clipped_windows(captures, anchor, minutes, k).select("window_id", "filter", *[v.alias(name) for name, v in figures.items()])
    return rows.select("window_id", "center_ts", "filter", "n_total", "n_included", "quality_pre", "quality_post", "snr_factor", "stability", "filter_quality", "first_ts", "last_ts")


def rates(kind: T.DataType, expected: float) -> dict[str, Column]:
    """The figures of filter_quality from the columns of clipped_windows, by name; times are of the given kind."""
    cv = F.when(F.col("mean_in") <= 1e-9, 1.0).otherwise(F.try_divide(F.sqrt(F.col("squares_in") / F.col("n_in")), F.col("mean_in")))
    snr, stability = F.least(F.lit(1.0), F.sqrt(F.col("n_in") / F.lit(float(expected)))), 1 / (1 + cv)
    times = {name: F.timestamp_micros(c).cast(kind) for name, c in {"center_ts": "c", "first_ts": "first_t", "last_ts": "last_t"}.items()}
    return times | {"n_total": F.col("n"), "n_included": F.col("n_in"), "quality_pre": F.col("mean"), "quality_post": F.col("mean_in"), "snr_factor": snr, "stability": stability, "filter_quality": F.round(F.col("mean_in") * snr * stability, 4)}


def complete_windows(quality: DataFrame, required: list[str]) -> DataFrame:
    """Windows that have every required filter: (window_id, center_ts, n_filters, window_quality, rotation_degrees).

    The quality is the geometric mean of the filters' rounded qualities, 0 if one of them is; the rotation is that of 0.6
    degrees a minute over the captures used.
    """
    q = F.col("filter_quality")
    g = quality.where(F.col("filter").isin(*required)).groupBy("window_id", "center_ts").agg(
        F.count_distinct("filter").alias("n_filters"), F.min(q).alias("_least"), F.avg(F.when(q > 0, F.log(q))).alias("_log"),
        (F.max(seconds(F.col("last_ts"))) - F.min(seconds(F.col("first_ts")))).alias("_span"),
    ).where(F.col("n_filters") == len(required))
    mean = F.when(F.col("_least") > 0, F.exp("_log")).otherwise(0.0)
    return g.select("window_id", "center_ts", "n_filters", F.round(mean, 4).alias("window_quality"), (F.col("_span") / 60 * 0.6).alias("rotation_degrees"))


def search(captures: DataFrame, required: list[str], minutes: float, cycle: float, k: float = 1.5, threshold: float = 0.0) -> DataFrame:
    """Every complete window: score, filter, clip and rate the captures around each anchor."""
    scored = min_quality(norm_scores(captures), threshold)
    rated = rated_windows(scored, minutes, minutes / cycle, k, "IR" if "IR" in required else required[0])
    return complete_windows(rated, required)


def top_overlap(windows: DataFrame, n: int) -> DataFrame:
    """The n best windows; ties by time."""
    return windows.orderBy(F.desc("window_quality"), "center_ts", "window_id").limit(n)


def top_disjoint(windows: DataFrame, n: int, minutes: float) -> DataFrame:
    """Best first, each at least `minutes` from all chosen before; with window_index from 1.

    The windows are rated once and written. n passes over them, each a best-of without a sort, look only at what is far
    enough from those chosen; only the chosen rows reach the driver.
    """
    spark, chosen = windows.sparkSession, []
    left = materialise(windows.withColumn("_c", seconds(F.col("center_ts"))))
    order = F.struct(-F.col("window_quality"), "center_ts", "window_id")
    for i in range(n):
        best = left.agg(F.min_by(F.struct(*left.columns), order).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append((*best[:-1], i + 1))
        left = left.where(F.abs(F.col("_c") - best["_c"]) >= minutes * 60)
    return spark.createDataFrame(chosen, T.StructType([*windows.schema.fields, T.StructField("window_index", T.IntegerType())]))


def nested(quality: DataFrame, members: DataFrame) -> DataFrame:
    """Windows with a map from filter to its figures and lists of included and excluded captures, for JSON."""
    entry = F.struct("stem", "ts", "norm_score")
    lists = members.groupBy("window_id", "filter").agg(F.sort_array(F.collect_list(F.when(F.col("included"), entry))).alias("included"), F.sort_array(F.collect_list(F.when(~F.col("included"), entry))).alias("excluded"))
    joined = quality.join(lists, ["window_id", "filter"])
    value = F.struct("n_total", "n_included", "quality_pre", "quality_post", "snr_factor", "stability", "filter_quality", "included", "excluded")
    return joined.groupBy("window_id", "center_ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("filter", value)))).alias("per_filter"))


def nested_windows(captures: DataFrame, minutes: float, expected: float, k: float = 1.5, anchor: str = "IR") -> DataFrame:
    """The same as nested(filter_quality(clipped), clipped) for all windows around the captures of the anchor filter.

    A window is one row that holds all its members, so it is made where they lie: a bucket of time keeps what its anchors need as one
    list for each filter (of one and a half windows), and each anchor takes its members from there. So rows that are shuffled are linear in
    the captures. Figures come from sums, where captures without a score do not count.
    """
    half, parts = minutes * 60.0 / 2, many_tasks(captures.sparkSession)
    kind = captures.schema["ts"].dataType
    names = ("n_total", "n_included", "quality_pre", "quality_post", "snr_factor", "stability", "filter_quality")
    figures = rates(kind, expected)
    found = by_window(clipped_windows(captures, anchor, minutes, k), F.struct(*[figures[n].alias(n) for n in names], "floor"), "_rated")
    centre = found.withColumn("_c", F.col("_t") / F.lit(1e6)).withColumn("_b", F.floor(F.col("_c") / half)).repartition(parts, "_b")
    member = captures.where(F.col("norm_score").isNotNull()).withColumn("_s", seconds(F.col("ts"))).withColumn("_b", buckets(F.col("_s"), half, half)).repartition(parts, "_b")
    lists = member.groupBy("_b", F.coalesce("filter", F.lit("")).alias("_f")).agg(F.array_sort(F.collect_list(F.struct("stem", "ts", "norm_score", "_s"))).alias("_l"))
    held = lists.groupBy("_b").agg(F.map_from_entries(F.collect_list(F.struct("_f", "_l"))).alias("_held"))

    def entry(f: Column, r: Column) -> Column:
        def listed(kept: bool) -> Column:
            def of(m: Column) -> Column:
                inn = m["norm_score"] >= r["floor"]
                return (F.abs(m["_s"] - F.col("_c")) <= half) & (inn if kept else ~inn)

            return F.transform(F.filter(F.col("_held")[f], of), lambda m: F.struct(m["stem"].alias("stem"), m["ts"].alias("ts"), m["norm_score"].alias("norm_score")))

        return F.struct(*[r[n].alias(n) for n in names], listed(True).alias("included"), listed(False).alias("excluded"))

    return centre.join(held, "_b").select("window_id", F.timestamp_micros("_t").cast(kind).alias("center_ts"), F.transform_values("_rated", entry).alias("per_filter"))
