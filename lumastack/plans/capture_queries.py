"""Queries over captures: catalogs, window search, series, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumastack.operators import catalog, report, series, windows
from lumastack.plans.proxies import CAPTURES_SQL, FILTERS, PATHS_SQL, captures, paths
from lumastack.plans.register import registrar
from lumastack.sources.shared import materialise, shared_dir

REQUIRED = ["IR", "R", "G", "B", "CH4"]
MINUTES, CYCLE, K, TOP = 60.0, 15.0, 1.5, 3
SERIES_MINUTES, SERIES_NEEDS = 30.0, ["R", "G", "B"]

QUERIES, ORACLE_SQL, query = registrar()


# -- catalog ------------------------------------------------------------------------------------------------------------
TENTHS = "least(9, CAST(round_even(ss / 6.0, 0) AS INTEGER))"
META_SQL = f"""WITH {PATHS_SQL},
meta AS (SELECT event_id, path, modified, CASE event_id % 4 WHEN 0 THEN regexp_extract(path, '-U-([A-Z0-9]+)-', 1) END AS f0, CASE event_id % 4 WHEN 0 THEN 'Jup' WHEN 1 THEN 'Sat' WHEN 2 THEN CASE WHEN event_id % 8 = 2 THEN 'Mar' END END AS target,
  date_trunc('minute', modified) + to_seconds(6 * CASE event_id % 4 WHEN 0 THEN CAST(ss AS INTEGER) // 6 ELSE {TENTHS} END) AS ts, strftime(modified, '%Y-%m-%d') AS date,
  regexp_replace(regexp_extract(path, '[^/]*$'), '\\.tif$', '') AS stem, ss FROM paths WHERE event_id % 4 < 3)"""


@query(META_SQL + " SELECT event_id, date, ts, f0 AS filter, target, stem FROM meta")
def parse_capture_name(spark: SparkSession, sf: str) -> DataFrame:
    found = paths(spark, sf).select("event_id", catalog.parse_capture_name(F.col("path"), F.col("modified")).alias("m"))
    return found.where("m IS NOT NULL").select("event_id", "m.*")


@query(f"WITH {PATHS_SQL} SELECT event_id, strftime(modified, '%Y-%m-%d') AS date, CASE WHEN event_id % 8 = 2 THEN 'Mar' END AS target FROM paths WHERE event_id % 4 = 2")
def folder_metadata(spark, sf):
    p = paths(spark, sf).where(F.col("event_id") % 4 == 2)
    return p.select("event_id", catalog.folder_date(F.col("path"), F.col("modified")).alias("date"), catalog.folder_target(F.col("path")).alias("target"))


@query(f"WITH {PATHS_SQL} SELECT event_id, strftime(modified, '%Y-%m-%d') AS date, CASE WHEN event_id % 8 = 2 THEN 'Mar' END AS target FROM paths")
def folder_metadata_all(spark, sf):
    return paths(spark, sf).select("event_id", catalog.folder_date(F.col("path"), F.col("modified")).alias("date"), catalog.folder_target(F.col("path")).alias("target"))


@query(META_SQL + f"""SELECT p.event_id, CASE p.event_id % 4 WHEN 0 THEN stem WHEN 3 THEN 'notes' || CAST(p.event_id AS VARCHAR)
  ELSE strftime(p.modified, '%Y-%m-%d-%H%M') || '_' || CAST({TENTHS.replace('ss', 'p.ss')} AS VARCHAR) || '-U-IR-Jup' END AS stem FROM paths p LEFT JOIN meta m USING (event_id)""")
def canonical_stem(spark, sf):
    return paths(spark, sf).select("event_id", catalog.canonical_stem(F.col("path"), F.lit("IR"), F.lit("Jup"), modified=F.col("modified")).alias("stem"))


@query(META_SQL + " SELECT path, date, ts, coalesce(f0, 'color') AS filter, target, stem FROM meta WHERE target IS NULL OR target = 'Jup'")
def capture_catalog(spark, sf):
    return catalog.capture_catalog(paths(spark, sf), "Jup", modified_col="modified")


@query(META_SQL + " SELECT path, date, ts, coalesce(f0, 'color') AS filter, target, stem FROM meta WHERE coalesce(f0, 'color') IN ('color', 'R', 'G')")
def series_catalog(spark, sf):
    return catalog.series_catalog(paths(spark, sf), ["R", "G"])


@query(META_SQL + " SELECT path, date, ts, coalesce(f0, 'color') AS filter, target, stem FROM meta")
def color_catalog(spark, sf):
    return catalog.capture_catalog(paths(spark, sf))


@query(META_SQL + " SELECT event_id, coalesce(f0, 'L') AS filter FROM meta")
def filter_from_name(spark, sf):
    stem = catalog.parse_capture_name(F.col("path"), F.col("modified"))
    found = paths(spark, sf).select("event_id", stem.alias("m")).where("m IS NOT NULL")
    return found.select("event_id", catalog.filter_from_name(F.col("m.stem")).alias("filter"))


@query(META_SQL + ", f AS (SELECT coalesce(f0, 'color') AS filter, stem AS name, row_number() OVER (PARTITION BY coalesce(f0, 'color') ORDER BY stem) AS r, count(*) OVER (PARTITION BY coalesce(f0, 'color')) AS n FROM meta) SELECT filter, name FROM f WHERE filter = 'IR' AND r = n // 2 + 1")
def pick_reference_file(spark, sf):
    return catalog.pick_reference_file(catalog.capture_catalog(paths(spark, sf)).select("filter", F.col("stem").alias("name")))


@query(META_SQL + """, f AS (SELECT coalesce(f0, 'color') AS filter, stem AS name FROM meta), a AS (SELECT 'late' AS pick, filter, name FROM f WHERE filter IN ('B', 'CH4', 'color') UNION ALL SELECT 'forced', filter, name FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY pick ORDER BY name) AS r, count(*) OVER (PARTITION BY pick) AS n FROM a WHERE CASE pick WHEN 'late' THEN filter = 'B' ELSE contains(upper(name), 'AP47') END)
SELECT pick, filter, name FROM r WHERE r = n // 2 + 1""")
def pick_reference_late(spark, sf):
    """The reference where IR, R and G are missing, and with a forced name in another case."""
    files = materialise(catalog.capture_catalog(paths(spark, sf)).select("filter", F.col("stem").alias("name")))  # each name is parsed once
    late = catalog.pick_reference_file(files.where(F.col("filter").isin("B", "CH4", "color")))
    forced = catalog.pick_reference_file(files, forced="Ap47")
    return late.select(F.lit("late").alias("pick"), "filter", "name").unionByName(forced.select(F.lit("forced").alias("pick"), "filter", "name"))


@query(f"WITH {CAPTURES_SQL} SELECT filter, count(*) AS n, count(*) >= 12 AS feasible FROM captures GROUP BY filter")
def preflight_counts(spark, sf):
    return catalog.preflight_counts(captures(spark, sf), 4, 3)


@query("SELECT 60.0 / 15.0 AS expected, CAST(count(*) AS BIGINT) AS n, 4 * 15.0 AS window_minutes FROM events")
def derived_window_minutes(spark, sf):
    return captures(spark, sf).agg(F.count("*").alias("n")).select(F.lit(MINUTES / CYCLE).alias("expected"), "n", F.lit(4 * CYCLE).alias("window_minutes"))


# -- window search ------------------------------------------------------------------------------------------------------
SCORED_SQL = CAPTURES_SQL + """, span AS (SELECT filter, min(raw_score) AS lo, max(raw_score) AS hi FROM captures GROUP BY filter),
scored AS (SELECT c.*, (raw_score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS norm_score FROM captures c JOIN span USING (filter))"""
MEMBERS_SQL = SCORED_SQL + f""", members AS (SELECT a.stem AS window_id, a.ts AS center_ts, m.filter, m.stem, m.ts, m.s, m.norm_score FROM scored a JOIN scored m ON abs(m.s - a.s) <= {MINUTES * 30} WHERE a.filter = 'IR')"""
CLIPPED_SQL = MEMBERS_SQL + f""", c0 AS (SELECT *, norm_score >= avg(norm_score) OVER g - {K} * stddev_pop(norm_score) OVER g AS inn FROM members WINDOW g AS (PARTITION BY window_id, filter)),
clipped AS (SELECT window_id, center_ts, filter, stem, ts, s, norm_score, inn OR (row_number() OVER (PARTITION BY window_id, filter ORDER BY norm_score DESC, ts, stem) = 1 AND NOT bool_or(inn) OVER (PARTITION BY window_id, filter)) AS included FROM c0)"""
RATED_SQL = CLIPPED_SQL + f""", r0 AS (SELECT window_id, center_ts, filter, count(*) AS n_total, count(*) FILTER (included) AS n_included, avg(norm_score) AS quality_pre, avg(norm_score) FILTER (included) AS quality_post,
  stddev_pop(norm_score) FILTER (included) AS sd, min(ts) FILTER (included) AS first_ts, max(ts) FILTER (included) AS last_ts, min(s) FILTER (included) AS s0, max(s) FILTER (included) AS s1 FROM clipped GROUP BY ALL),
rated AS (SELECT *, least(1.0, sqrt(n_included / {MINUTES / CYCLE})) AS snr_factor, 1 / (1 + CASE WHEN quality_post <= 1e-9 THEN 1.0 ELSE sd / quality_post END) AS stability FROM r0),
quality AS (SELECT *, round(quality_post * snr_factor * stability, 4) AS filter_quality FROM rated)"""
WINDOWS_SQL = RATED_SQL + """, w0 AS (SELECT window_id, center_ts, count(DISTINCT filter) AS n_filters, min(filter_quality) AS least_q, avg(CASE WHEN filter_quality > 0 THEN ln(filter_quality) END) AS lg, max(s1) - min(s0) AS span FROM quality GROUP BY ALL HAVING count(DISTINCT filter) = 5),
windows AS (SELECT window_id, center_ts, n_filters, CASE WHEN least_q > 0 THEN round(exp(lg), 4) ELSE round(0.0, 4) END AS window_quality, span / 60 * 0.6 AS rotation_degrees FROM w0)"""


def rated(spark, sf):
    return windows.rated_windows(windows.norm_scores(captures(spark, sf)), MINUTES, MINUTES / CYCLE, K)


@query(f"WITH {CAPTURES_SQL} SELECT stem, 0.5 * raw_score + 0.3 * (raw_score / 2) + 0.2 * (raw_score / 4) AS raw FROM captures")
def raw_score(spark, sf):
    v = F.col("raw_score")
    return captures(spark, sf).select("stem", windows.raw_score(v, v / 2, v / 4).alias("raw"))


@query(f"WITH {SCORED_SQL} SELECT stem, filter, norm_score FROM scored")
def norm_score(spark, sf):
    return windows.norm_scores(captures(spark, sf)).select("stem", "filter", "norm_score")


@query(f"WITH {SCORED_SQL} SELECT stem, filter, CAST(row_number() OVER (PARTITION BY filter ORDER BY norm_score DESC, ts, stem) AS INTEGER) AS rank FROM scored")
def quality_rank(spark, sf):
    return windows.quality_rank(windows.norm_scores(captures(spark, sf))).select("stem", "filter", "rank")


@query(f"WITH {SCORED_SQL} SELECT stem, norm_score FROM scored WHERE norm_score >= 0.05")
def min_quality_filter(spark, sf):
    return windows.min_quality(windows.norm_scores(captures(spark, sf)), 0.05).select("stem", "norm_score")


@query(f"WITH {MEMBERS_SQL} SELECT window_id, center_ts, filter, stem, ts, norm_score FROM members")
def anchor_windows(spark, sf):
    return windows.anchor_windows(windows.norm_scores(captures(spark, sf)), MINUTES)


@query(f"WITH {CLIPPED_SQL} SELECT window_id, filter, stem, included FROM clipped")
def window_sigma_clip(spark, sf):
    return windows.clipped_members(windows.norm_scores(captures(spark, sf)), MINUTES, K).select("window_id", "filter", "stem", "included")


@query(f"WITH {RATED_SQL} SELECT window_id, center_ts, filter, n_total, n_included, quality_pre, quality_post, snr_factor, stability, filter_quality, first_ts, last_ts FROM quality")
def window_filter_quality(spark, sf):
    return rated(spark, sf)


@query(f"WITH {WINDOWS_SQL} SELECT window_id, n_filters FROM windows")
def complete_windows(spark, sf):
    return windows.complete_windows(rated(spark, sf), REQUIRED).select("window_id", "n_filters")


@query(f"WITH {WINDOWS_SQL} SELECT * FROM windows")
def window_quality(spark, sf):
    return windows.search(captures(spark, sf), REQUIRED, MINUTES, CYCLE, K)


@query(f"WITH {WINDOWS_SQL} SELECT window_id, rotation_degrees FROM windows")
def rotation_span(spark, sf):
    return windows.search(captures(spark, sf), REQUIRED, MINUTES, CYCLE, K).select("window_id", "rotation_degrees")


@query(f"WITH {WINDOWS_SQL} SELECT * FROM windows ORDER BY window_quality DESC, center_ts, window_id LIMIT {TOP}")
def top_windows_overlap(spark, sf):
    return windows.top_overlap(windows.search(captures(spark, sf), REQUIRED, MINUTES, CYCLE, K), TOP)


def best_windows(spark: SparkSession, sf: str, minutes: float = MINUTES, cycle: float = CYCLE, n: int = TOP) -> DataFrame:
    """The flagship: the n best windows that do not overlap, over all five filters."""
    return windows.top_disjoint(windows.search(captures(spark, sf), REQUIRED, minutes, cycle, K), n, minutes)


@query(f"""WITH RECURSIVE {WINDOWS_SQL}, o AS (SELECT *, epoch_us(center_ts) / 1e6 AS c, row_number() OVER (ORDER BY window_quality DESC, center_ts, window_id) AS r FROM windows),
pick AS (SELECT 1 AS k, (SELECT [c] FROM o WHERE r = 1) AS cs, (SELECT 1) AS r WHERE EXISTS (SELECT 1 FROM o)
 UNION ALL SELECT k + 1, list_append(cs, o.c), o.r FROM pick, o WHERE k < {TOP} AND o.r = (SELECT min(p.r) FROM o p WHERE len(list_filter(cs, lambda z: abs(z - p.c) < {MINUTES * 60})) = 0))
SELECT o.window_id, o.center_ts, o.n_filters, o.window_quality, o.rotation_degrees, CAST(k AS INTEGER) AS window_index FROM pick JOIN o ON o.r = pick.r""")
def top_windows_disjoint(spark, sf):
    return best_windows(spark, sf)


@query(f"WITH {CAPTURES_SQL} SELECT DISTINCT filter FROM captures")
def required_filters(spark, sf):
    return captures(spark, sf).select("filter").distinct()


@query()
def windows_json(spark, sf):
    nested = windows.nested_windows(windows.norm_scores(captures(spark, sf)), MINUTES, MINUTES / CYCLE, K)
    return nested.select("window_id", F.to_json("per_filter").alias("per_filter"))


@query(f"WITH {SCORED_SQL} SELECT ts, filter, stem, round(raw_score, 2) AS raw_score, round(norm_score, 6) AS norm_score FROM scored")
def quality_scores_sink(spark, sf):
    return report.score_rows(windows.norm_scores(captures(spark, sf)))


@query(f"""WITH {WINDOWS_SQL}, top AS (SELECT *, row_number() OVER (ORDER BY window_quality DESC, center_ts, window_id) AS window_index FROM windows QUALIFY row_number() OVER (ORDER BY window_quality DESC, center_ts, window_id) <= {TOP}),
i AS (SELECT window_id, filter, count(*) FILTER (included) AS n_in, count(*) FILTER (NOT included) AS n_out, min(stem) FILTER (included) AS first_in FROM clipped GROUP BY ALL)
SELECT CAST(window_index AS INTEGER) AS window_index, window_id, window_quality, rotation_degrees, q.filter, n_total, n_included, filter_quality, n_in, n_out, first_in FROM top JOIN quality q USING (window_id) JOIN i USING (window_id, filter)""")
def windows_json_sink(spark, sf):
    """The chosen windows written as nested JSON, and what is read back, flat: a row for each window and filter. Windows are chosen by sums; only the
    members of those chosen are looked up."""
    scored = windows.norm_scores(captures(spark, sf))
    best = materialise(windows.top_overlap(windows.search(captures(spark, sf), REQUIRED, MINUTES, CYCLE, K), TOP))
    clipped = materialise(windows.sigma_clip(windows.around(scored, best.select("window_id", "center_ts"), MINUTES), K))
    place = windows.ranked(best.withColumn("_one", F.lit(1)), "_one", F.desc("window_quality"), "center_ts", "window_id", name="window_index").drop("_one")
    nested = windows.nested(windows.filter_quality(clipped, MINUTES / CYCLE), clipped)
    path = f"{shared_dir(spark)}/windows/{uuid.uuid4().hex}"
    report.window_sink(place, nested, path)
    schema = place.join(nested.drop("center_ts"), "window_id").schema
    flat = spark.read.schema(schema).json(path).select("window_index", "window_id", "window_quality", "rotation_degrees", F.explode("per_filter").alias("filter", "f"))
    return flat.select("window_index", "window_id", "window_quality", "rotation_degrees", "filter", "f.n_total", "f.n_included", "f.filter_quality", F.size("f.included").cast("bigint").alias("n_in"), F.size("f.excluded").cast("bigint").alias("n_out"), F.array_min(F.transform("f.included", lambda c: c["stem"])).alias("first_in"))


# -- series -------------------------------------------------------------------------------------------------------------
CYCLES_SQL = CAPTURES_SQL + f""", b AS (SELECT *, CAST(floor((s - min(s) OVER ()) / {SERIES_MINUTES * 60}) AS BIGINT) AS cycle_id, min(s) OVER () AS t0 FROM captures),
n AS (SELECT *, t0 + (cycle_id + 0.5) * {SERIES_MINUTES * 60} AS center_s FROM b),
best AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cycle_id, filter ORDER BY abs(s - center_s), ts, stem) = 1),
cycles AS (SELECT cycle_id, center_s, filter, stem, ts FROM best WHERE cycle_id IN (SELECT cycle_id FROM best WHERE filter IN ('R', 'G', 'B') GROUP BY cycle_id HAVING count(*) = 3))"""
ISLANDS_SQL = CYCLES_SQL + f""", one AS (SELECT DISTINCT cycle_id, center_s FROM cycles), gaps AS (SELECT *, CASE WHEN center_s - lag(center_s) OVER (ORDER BY center_s) > {2 * SERIES_MINUTES * 60} THEN 1 ELSE 0 END AS gap FROM one),
islands AS (SELECT cycle_id, center_s, CAST(sum(gap) OVER (ORDER BY center_s) AS BIGINT) AS island, CAST(row_number() OVER (ORDER BY center_s) AS INTEGER) AS position FROM gaps)"""


def cycles(spark, sf):
    return series.cycle_bins(captures(spark, sf), SERIES_MINUTES, SERIES_NEEDS)


@query(f"WITH {CYCLES_SQL} SELECT * FROM cycles")
def cycle_bins(spark, sf):
    return cycles(spark, sf)


@query(f"WITH {CAPTURES_SQL} SELECT filter AS channel FROM (SELECT DISTINCT filter FROM captures) WHERE filter IN ('R', 'G', 'B')")
def required_channels(spark, sf):
    return report.present_channels(captures(spark, sf), ["R", "G", "B"])


@query(f"WITH {ISLANDS_SQL} SELECT * FROM islands")
def cycle_islands(spark, sf):
    return series.cycle_islands(cycles(spark, sf), SERIES_MINUTES)


@query(f"WITH {ISLANDS_SQL} SELECT a.cycle_id, b.cycle_id AS near_id FROM islands a JOIN islands b ON a.island = b.island AND abs(a.position - b.position) <= 2")
def cycle_neighbourhoods(spark, sf):
    return series.neighbourhoods(series.cycle_islands(cycles(spark, sf), SERIES_MINUTES), 5)


@query(f"WITH {CYCLES_SQL} SELECT cycle_id, (min(epoch_us(ts)) / 1e6 + max(epoch_us(ts)) / 1e6) / 2 AS mid_s FROM cycles GROUP BY cycle_id")
def window_midpoint(spark, sf):
    return series.window_midpoint(cycles(spark, sf), "cycle_id")


@query(f"""WITH {SCORED_SQL}, k AS (SELECT stem, filter, session, norm_score, greatest(norm_score * norm_score, 0.05) AS own FROM scored)
SELECT stem, session, filter, count(*) FILTER (norm_score < 0.3) OVER g AS n_below, own / sum(own) OVER g AS weight FROM k WINDOW g AS (PARTITION BY session, filter)""")
def series_weights(spark, sf):
    scored = windows.norm_scores(captures(spark, sf))
    return series.series_weights(scored, ["session", "filter"], 0.3, "norm_score").select("stem", "session", "filter", "n_below", "weight")


@query(f"WITH {CYCLES_SQL}, d AS (SELECT stem, epoch_us(ts) / 1e6 - center_s AS dt FROM cycles) SELECT stem, CASE WHEN abs(dt) > 0.5 THEN 0.2 * dt * 0.0001 * 50 ELSE 0 END AS dx FROM d")
def residual_shift(spark, sf):
    dt = windows.seconds(F.col("ts")) - F.col("center_s")
    return cycles(spark, sf).select("stem", series.residual_shift(dt, F.lit(0.8), F.lit(0.0001), F.lit(50)).alias("dx"))


@query(f"""WITH {CAPTURES_SQL}, b AS (SELECT *, CAST(floor((s - min(s) OVER ()) / {SERIES_MINUTES * 60}) AS BIGINT) AS bin FROM captures),
m AS (SELECT bin, ts, count(*) OVER (PARTITION BY bin) AS n, row_number() OVER (PARTITION BY bin ORDER BY ts, stem) AS r FROM b)
SELECT bin, ts AS center_ts, n, CAST(row_number() OVER (ORDER BY bin) AS INTEGER) AS position FROM m WHERE r = n // 2 + 1""")
def color_bins(spark, sf):
    return series.color_bins(captures(spark, sf), SERIES_MINUTES)


@query(f"""WITH {CYCLES_SQL}, c AS (SELECT DISTINCT cycle_id, center_s FROM cycles), p AS (SELECT c.cycle_id, m.filter, m.stem, m.ts, abs(epoch_us(m.ts) / 1e6 - c.center_s) AS g FROM c JOIN cycles m USING (cycle_id))
SELECT cycle_id, filter, arg_min(stem, (g, ts, stem)) AS stem FROM p GROUP BY ALL""")
def single_frame_mode(spark, sf):
    rows = cycles(spark, sf)
    centers = rows.select("cycle_id", "filter", "center_s")
    return series.nearest_frame(rows.select("cycle_id", "filter", "stem", "ts"), centers, ["cycle_id", "filter"])


# -- reports ------------------------------------------------------------------------------------------------------------
@query(f"WITH {CYCLES_SQL} SELECT filter, list(stem ORDER BY ts, stem) AS stems FROM cycles GROUP BY filter")
def animation_sequence(spark, sf):
    return report.animation_sequence(cycles(spark, sf), "filter")


@query(f"WITH {CYCLES_SQL} SELECT filter, CAST(row_number() OVER (PARTITION BY filter ORDER BY ts, stem) AS INTEGER) AS position, stem FROM cycles")
def animation_frames(spark, sf):
    return report.animation_frames(cycles(spark, sf), "filter")


@query(f"""WITH {CYCLES_SQL} SELECT cycle_id, max(stem) FILTER (filter = 'IR') AS "IR", max(stem) FILTER (filter = 'R') AS "R", max(stem) FILTER (filter = 'G') AS "G", max(stem) FILTER (filter = 'B') AS "B", max(stem) FILTER (filter = 'CH4') AS "CH4", 5 - count(*) AS missing FROM cycles GROUP BY cycle_id""")
def summary_matrix(spark, sf):
    return report.summary_matrix(cycles(spark, sf), "cycle_id", REQUIRED)


@query(f"""WITH {RATED_SQL}, l AS (SELECT cast(event_id AS VARCHAR) AS window_id, count(*) AS x FROM events GROUP BY 1)
SELECT q.window_id, q.filter, q.n_included, q.n_total, q.quality_post, q.stability, q.n_included AS n_stacked FROM quality q""")
def filter_stats(spark, sf):
    q = rated(spark, sf)
    log = q.select("window_id", "filter", F.col("n_included").alias("n_stacked"))
    return report.filter_stats(q, log)


@query(f"WITH {CYCLES_SQL} SELECT DISTINCT cycle_id, strftime(to_timestamp(center_s) AT TIME ZONE 'Asia/Seoul', '%Y-%m-%d %H:%M') AS label FROM cycles")
def window_labels(spark, sf):
    return cycles(spark, sf).select("cycle_id", report.time_label(F.col("center_s"), "Asia/Seoul").alias("label")).distinct()


@query(f"WITH {CAPTURES_SQL} SELECT filter, CAST(session AS VARCHAR) AS session, count(*) AS n_in, count(*) FILTER (raw_score >= 50) AS n_stacked, count(*) FILTER (raw_score >= 50) / count(*) AS rate FROM captures GROUP BY ROLLUP (filter, session)")
def run_summary(spark, sf):
    return report.run_summary(captures(spark, sf), ["filter", "session"], F.col("raw_score") >= 50).withColumn("session", F.col("session").cast("string"))


@query(f"WITH {CAPTURES_SQL} SELECT filter, sqrt(count(*)) AS snr_gain FROM captures GROUP BY filter")
def snr_gain(spark, sf):
    return captures(spark, sf).groupBy("filter").agg(F.sqrt(F.count("*")).alias("snr_gain"))


@query(f"""WITH {CYCLES_SQL}, s AS (SELECT * FROM (VALUES ('RGB', 'R', 'R', 1), ('RGB', 'G', 'G', 2), ('RGB', 'B', 'B', 3), ('IR-RGB', 'L', 'IR', 0), ('IR-RGB', 'R', 'R', 1), ('IR-RGB', 'G', 'G', 2), ('IR-RGB', 'B', 'B', 3), ('CH4-G-IR', 'R', 'CH4', 1), ('CH4-G-IR', 'G', 'G', 2), ('CH4-G-IR', 'B', 'IR', 3)) t(name, role, filter, o)),
a AS (SELECT filter, avg(epoch_us(ts) / 1e6 - center_s) / 100 AS dx FROM cycles GROUP BY filter)
SELECT filter, max(CASE WHEN name = 'RGB' THEN r END) AS "RGB", max(CASE WHEN name = 'IR-RGB' THEN r END) AS "IR-RGB", max(CASE WHEN name = 'CH4-G-IR' THEN r END) AS "CH4-G-IR" FROM (SELECT a.filter, s.name, arg_min(role, o) || CASE WHEN abs(any_value(dx)) < 0.05 THEN ' ref' ELSE ' shifted' END AS r FROM s JOIN a USING (filter) GROUP BY a.filter, s.name) GROUP BY filter""")
def align_table(spark, sf):
    c = cycles(spark, sf)
    shifts = c.groupBy("filter").agg((F.avg(windows.seconds(F.col("ts")) - F.col("center_s")) / 100).alias("dx"))
    return report.align_table(shifts)


@query(f"WITH {CAPTURES_SQL} SELECT session, filter, count(*) AS n FROM captures GROUP BY ALL")
def stream_capture_counts(spark, sf):
    from lumastack.streaming.streams import capture_counts, run_to_end, table_stream

    events = table_stream(spark, sf, "events")
    kinds = F.create_map(*[F.lit(x) for pair in FILTERS.items() for x in pair])
    rows = events.select(F.col("user_id").alias("session"), kinds[F.col("event_type")].alias("filter"))
    return run_to_end(capture_counts(rows), "complete")


@query(f"WITH {CAPTURES_SQL} SELECT filter, CAST(floor(s / 1800) AS BIGINT) AS cycle, count(*) AS n FROM captures GROUP BY ALL")
def stream_cycle_counts(spark, sf):
    from lumastack.streaming.streams import cycle_counts, run_to_end, table_stream

    events = table_stream(spark, sf, "events")
    kinds = F.create_map(*[F.lit(x) for pair in FILTERS.items() for x in pair])
    rows = events.select("ts", kinds[F.col("event_type")].alias("filter"))
    return run_to_end(cycle_counts(rows, SERIES_MINUTES), "complete").select("filter", F.floor(F.unix_timestamp(F.col("start")) / 1800).alias("cycle"), "n")


@query(f"""WITH {CAPTURES_SQL}, g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY filter ORDER BY s) > 3600 THEN 1 ELSE 0 END AS gap FROM captures), i AS (SELECT *, sum(gap) OVER (PARTITION BY filter ORDER BY s) AS island FROM g)
SELECT filter, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, count(*) AS n FROM i GROUP BY filter, island""")
def stream_islands(spark, sf):
    from lumastack.streaming.streams import islands, run_to_end, table_stream

    kinds = F.create_map(*[F.lit(x) for pair in FILTERS.items() for x in pair])
    rows = table_stream(spark, sf, "events").select("ts", kinds[F.col("event_type")].alias("filter"))
    return run_to_end(islands(rows, SERIES_MINUTES), "complete").select("filter", F.floor(F.unix_timestamp(F.col("start"))).alias("first_s"), "n")
