"""Queries over frames: screening, metrics, selection, geometry, stacks, wavelets, composites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumastack.operators import composite, contours, derotate, fields, grids, kernels, report, series, stack
from lumastack.operators import frames as fr
from lumastack.operators.windows import norm_scores, raw_score, seconds
from lumastack.plans.proxies import FRAMES_SQL, PIXELS_SQL, SIDE, frames, frames_of, pixels
from lumastack.plans.register import registrar
from lumastack.sources.shared import shared_dir

QUERIES, ORACLE_SQL, query = registrar()
APS = [(x, y) for y in (2, 4, 6) for x in (2, 4, 6)]


def at(dy: int, dx: int, held: str = "l") -> str:
    """SQL for the pixel dy, dx away in a frame's list, mirrored at the borders."""

    def place(c: str, d: int) -> str:
        p = f"(abs({c} + ({d})) % 14)"
        return f"(CASE WHEN {p} < 8 THEN {p} ELSE 14 - {p} END)"

    return f"{held}[{place('y', dy)} * 8 + {place('x', dx)} + 1]"


def taps_sql(taps, step: int = 1, held: str = "l") -> str:
    half = len(taps) // 2
    return " + ".join(f"{float(a * b)!r} * {at((i - half) * step, (j - half) * step, held)}" for i, a in enumerate(taps) for j, b in enumerate(taps) if a * b)


LIST_SQL = PIXELS_SQL + ", held AS (SELECT frame_id, list(v ORDER BY y, x) AS l FROM pixels GROUP BY frame_id), grid AS (SELECT p.*, l FROM pixels p JOIN held USING (frame_id))"
LAPLACIAN = f"({at(-1, 0)} + {at(1, 0)} + {at(0, -1)} + {at(0, 1)} - 4 * l[y * 8 + x + 1])"
GX = f"({at(-1, 1)} + 2 * {at(0, 1)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(0, -1)} - {at(1, -1)})"
GY = f"({at(1, -1)} + 2 * {at(1, 0)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(-1, 0)} - {at(-1, 1)})"
GRADIENT_SQL = LIST_SQL + f", grad AS (SELECT *, {GX} * {GX} + {GY} * {GY} AS g2, {LAPLACIAN} AS lap FROM grid)"
METRICS_SQL = GRADIENT_SQL + ", metrics AS (SELECT frame_id, file_id, filter, ts, var_pop(lap) AS laplacian, avg(g2) AS tenengrad, CASE WHEN avg(v) > 1e-9 THEN var_pop(v) / avg(v) ELSE 0 END AS norm_variance FROM grad GROUP BY ALL)"
BYTES_SQL = PIXELS_SQL + ", stretch AS (SELECT *, CAST(round_even((v - min(v) OVER f) / CASE WHEN max(v) OVER f > min(v) OVER f THEN max(v) OVER f - min(v) OVER f ELSE 1 END * 255, 0) AS INTEGER) AS g FROM pixels WINDOW f AS (PARTITION BY frame_id))"
#: A score of each frame that is the same in both engines: its tenengrad.
SCORES_SQL = METRICS_SQL + ", scores AS (SELECT frame_id, file_id, filter, ts, tenengrad AS score FROM metrics)"


def pix(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(frames(spark, sf))


def metrics(spark, sf) -> DataFrame:
    return fr.quality_metrics(frames(spark, sf), ("frame_id", "file_id", "filter", "ts"))


def scores(spark, sf) -> DataFrame:
    return metrics(spark, sf).select("frame_id", "file_id", "filter", "ts", F.col("tenengrad").alias("score"))


def as_pixels(made: DataFrame) -> DataFrame:
    return pixels(made)


# -- screening ----------------------------------------------------------------------------------------------------------
@query(f"WITH {FRAMES_SQL} SELECT frame_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 300 / CASE WHEN list_max(embedding) * 300 > 255 THEN 65535.0 WHEN list_max(embedding) * 300 > 1 THEN 255.0 ELSE 1.0 END) AS px FROM frames")
def range_normalise(spark, sf):
    raw = spark.read.parquet(f"{sf}/embeddings.parquet")
    px = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 300)
    return raw.select(F.col("vec_id").alias("frame_id"), fr.range_normalised(px).alias("px"))


@query(f"WITH {BYTES_SQL} SELECT frame_id, y, x, CAST(g AS DOUBLE) AS v FROM stretch")
def to_gray8(spark, sf):
    return as_pixels(fr.with_px(frames(spark, sf), lambda a: kernels.gray8(a).astype(float))).select("frame_id", "y", "x", "v")


@query(f"WITH {LIST_SQL} SELECT frame_id, y, x, {taps_sql(kernels.B3)} AS v FROM grid")
def gauss_blur(spark, sf):
    return as_pixels(fr.with_px(frames(spark, sf), lambda a: kernels.separable(a, kernels.B3))).select("frame_id", "y", "x", "v")


@query(f"""WITH {BYTES_SQL}, h AS (SELECT frame_id, g, count(*) AS c FROM stretch GROUP BY ALL), cum AS (SELECT frame_id, g, CAST(sum(c) OVER w AS DOUBLE) AS n, CAST(sum(c * g) OVER w AS DOUBLE) AS s, CAST(sum(c * g) OVER a AS DOUBLE) AS t FROM h WINDOW w AS (PARTITION BY frame_id ORDER BY g), a AS (PARTITION BY frame_id)),
b AS (SELECT frame_id, g, CASE WHEN n < 64 THEN (64 * s - n * t) * (64 * s - n * t) / (n * (64 - n)) ELSE 0 END AS d FROM cum) SELECT frame_id, CAST(arg_max(g, (d, -g)) AS INTEGER) AS otsu FROM b GROUP BY frame_id""")
def threshold_otsu(spark, sf):
    return fr.thresholds(frames(spark, sf)).select("frame_id", "otsu")


@query()
def threshold_triangle(spark, sf):
    return fr.thresholds(frames(spark, sf)).select("frame_id", "triangle")


@query()
def largest_component(spark, sf):
    return fr.components(frames(spark, sf))


BOX_SQL = PIXELS_SQL + ", lit AS (SELECT frame_id, file_id, ts, y, x FROM pixels WHERE v > 0.62), box AS (SELECT frame_id, any_value(file_id) AS file_id, min(x) AS bx, min(y) AS bby, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM lit GROUP BY frame_id)"
REJECT_SQL = "CASE WHEN bx < 1 OR bby < 1 OR bx + bw > 7 OR bby + bh > 7 THEN 'border' WHEN least(bw, bh) / greatest(bw, bh) < 0.7 THEN 'aspect' WHEN greatest(bw, bh) < 3 THEN 'small' END"


def boxes(spark, sf) -> DataFrame:
    lit = pix(spark, sf).where(F.col("v") > 0.62)
    g = lit.groupBy("frame_id").agg(F.first("file_id").alias("file_id"), F.first("h").alias("h"), F.first("w").alias("w"), F.min("x").alias("bx"), F.min("y").alias("by"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"))
    return g.withColumn("edge", F.lit(0.5))


@query(f"WITH {BOX_SQL} SELECT frame_id, {REJECT_SQL} AS reject, bx + bw / 2 AS cx, bby + bh / 2 AS cy FROM box")
def screen_shape(spark, sf):
    return fr.screen_shape(boxes(spark, sf)).select("frame_id", "reject", "cx", "cy")


@query(f"WITH {BOX_SQL}, r AS (SELECT file_id, {REJECT_SQL} AS reject FROM box) SELECT CAST(file_id AS VARCHAR) AS file_id, count(*) AS total, count(*) FILTER (reject IS NULL) AS accepted, count(reject) AS rejected_detect, CAST(0 AS BIGINT) AS rejected_size, count(*) FILTER (reject IS NULL) / count(*) AS rate FROM r GROUP BY ROLLUP (file_id)")
def screen_stats(spark, sf):
    return fr.screen_stats(fr.screen_shape(boxes(spark, sf))).withColumn("file_id", F.col("file_id").cast("string"))


SIZE_GATE_SQL = f"""WITH RECURSIVE {BOX_SQL}, o AS (SELECT file_id, frame_id, CAST(bw AS DOUBLE) AS bw, CAST(bh AS DOUBLE) AS bh, row_number() OVER (PARTITION BY file_id ORDER BY frame_id) AS i FROM box),
s AS (SELECT file_id, frame_id, i, [bw] AS ws, [bh] AS hs, true AS accepted FROM o WHERE i = 1
 UNION ALL SELECT file_id, nxt, i + 1, CASE WHEN g THEN list_append(ws, bw)[-100:] ELSE ws END, CASE WHEN g THEN list_append(hs, bh)[-100:] ELSE hs END, g
 FROM (SELECT s.file_id, s.i, s.ws, s.hs, o.frame_id AS nxt, o.bw, o.bh, len(s.ws) < 20 OR (o.bw >= list_aggregate(s.ws, 'median') * 0.95 AND o.bh >= list_aggregate(s.hs, 'median') * 0.95) AS g FROM s JOIN o ON o.file_id = s.file_id AND o.i = s.i + 1))
SELECT file_id, frame_id AS frame_idx, accepted FROM s"""


@query(SIZE_GATE_SQL)
def size_gate(spark, sf):
    return fr.size_gate(fr.lit_boxes(frames(spark, sf), 0.62).withColumn("frame_idx", F.col("frame_id")))


@query(SIZE_GATE_SQL)
def stream_size_gate(spark, sf):
    from lumastack.streaming.streams import run_to_end, size_gate_stream, table_stream

    sizes = fr.lit_boxes(frames_of(table_stream(spark, sf, "embeddings")), 0.62).withColumn("frame_idx", F.col("frame_id"))
    return run_to_end(size_gate_stream(sizes.select("file_id", "frame_idx", "bw", "bh")), "append")


EDGE_SQL = PIXELS_SQL + """, lit AS (SELECT frame_id, y, x FROM pixels WHERE v > 0.55), box AS (SELECT frame_id, min(x) AS bx, min(y) AS bby, max(x) AS rx, max(y) AS ry FROM lit GROUP BY frame_id),
e AS (SELECT frame_id, bx, bby, rx - bx + 1 AS bw, ry - bby + 1 AS bh, greatest(count(*) FILTER (y = bby) / (rx - bx + 1), count(*) FILTER (y = ry) / (rx - bx + 1), count(*) FILTER (x = bx) / (ry - bby + 1), count(*) FILTER (x = rx) / (ry - bby + 1)) AS edge FROM lit JOIN box USING (frame_id) GROUP BY frame_id, bx, bby, rx, ry)"""


@query(f"WITH {EDGE_SQL} SELECT frame_id, edge, CASE WHEN bx < 0 OR bby < 0 OR bx + bw > 8 OR bby + bh > 8 THEN 'border' WHEN least(bw, bh) / greatest(bw, bh) < 0.3 THEN 'aspect' WHEN edge > 0.5 THEN 'edge' WHEN greatest(bw, bh) < 6 THEN 'small' END AS reject FROM e")
def screen_edges(spark, sf):
    """The straight-edge rule on measured boxes, which reach the border in most of the given frames, so no padding is asked."""
    return fr.screen_shape(fr.lit_boxes(frames(spark, sf), 0.55), 0, 0.7, 0.5, 6).select("frame_id", "edge", "reject")


@query(f"WITH {PIXELS_SQL}, c AS (SELECT frame_id, round_even(4 + (frame_id % 5) / 2.0, 0) - 2 AS l, round_even(3.5, 0) - 2 AS t FROM frames), g AS (SELECT frame_id, i, CAST(i // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, t + i // 4 AS sy, l + i % 4 AS sx FROM c, range(16) r(i)) SELECT g.frame_id, g.y, g.x, coalesce(p.v, 0) AS v FROM g LEFT JOIN pixels p ON p.frame_id = g.frame_id AND p.y = sy AND p.x = sx")
def crop_center(spark, sf):
    made = fr.crop_center(frames(spark, sf), 4, 4 + (F.col("frame_id") % 5) / 2.0, F.lit(3.5))
    return as_pixels(made).select("frame_id", "y", "x", "v")


@query(f"WITH {PIXELS_SQL}, c AS (SELECT frame_id, 2 * round_even((4 + (frame_id % 5) / 2.0) / 2, 0) - 2 AS l, 2 * round_even(3.5 / 2, 0) - 2 AS t FROM frames), g AS (SELECT frame_id, i, CAST(i // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, t + i // 4 AS sy, l + i % 4 AS sx FROM c, range(16) r(i)) SELECT g.frame_id, g.y, g.x, coalesce(p.v, 0) AS v FROM g LEFT JOIN pixels p ON p.frame_id = g.frame_id AND p.y = sy AND p.x = sx")
def crop_center_bayer(spark, sf):
    made = fr.crop_center(frames(spark, sf), 5, 4 + (F.col("frame_id") % 5) / 2.0, F.lit(3.5), bayer=True)
    return as_pixels(made).select("frame_id", "y", "x", "v")


# -- metrics ------------------------------------------------------------------------------------------------------------
@query(f"WITH {METRICS_SQL} SELECT frame_id, laplacian FROM metrics")
def laplacian_var(spark, sf):
    return metrics(spark, sf).select("frame_id", "laplacian")


@query(f"WITH {METRICS_SQL} SELECT frame_id, tenengrad FROM metrics")
def tenengrad(spark, sf):
    return metrics(spark, sf).select("frame_id", "tenengrad")


@query(f"WITH {METRICS_SQL} SELECT frame_id, norm_variance FROM metrics")
def norm_variance(spark, sf):
    return metrics(spark, sf).select("frame_id", "norm_variance")


@query()
def frame_quality(spark, sf):
    return fr.frame_quality(frames(spark, sf))


@query(f"""WITH {PIXELS_SQL}, top AS (SELECT *, v / max(v) OVER (PARTITION BY frame_id) AS u FROM pixels), b0 AS (SELECT frame_id, list(u ORDER BY y, x) AS l FROM top GROUP BY 1),
b1 AS (SELECT t.frame_id, t.y, t.x, t.u, {taps_sql(kernels.B3)} AS s FROM top t JOIN b0 USING (frame_id)), b2 AS (SELECT frame_id, list(s ORDER BY y, x) AS l FROM b1 GROUP BY 1), b3 AS (SELECT b1.frame_id, u, {LAPLACIAN} AS lap FROM b1 JOIN b2 USING (frame_id))
SELECT frame_id, CASE WHEN count(*) FILTER (u > 0.25) >= 50 THEN var_pop(lap) FILTER (u > 0.25) ELSE 0 END AS score FROM b3 GROUP BY 1""".replace("SELECT frame_id, CASE", "SELECT frame_id, CASE"))
def log_disk_score_b3(spark, sf):
    import numpy as np

    def kernel(a, _):
        a = a / a.max((1, 2), keepdims=True)
        mask = a > 0.25
        lap = kernels.laplacian(kernels.separable(a, kernels.B3))
        return {"score": np.array([x[m].var() if m.sum() >= 50 else 0.0 for x, m in zip(lap, mask, strict=True)])}

    return fr.per_stack(frames(spark, sf), kernel, "score double")


@query()
def log_disk_score(spark, sf):
    return fr.log_disk_score(frames(spark, sf))


AP_SQL = GRADIENT_SQL + ", aps AS (SELECT CAST(row_number() OVER (ORDER BY ay, ax) - 1 AS INTEGER) AS ap_id, ax, ay FROM (SELECT a * 2 AS ax, b * 2 AS ay FROM range(1, 4) p(a), range(1, 4) q(b))), ap_scores AS (SELECT g.frame_id, a.ap_id, max(g2) AS score FROM grad g JOIN aps a ON g.x >= ax - 2 AND g.x < ax + 2 AND g.y >= ay - 2 AND g.y < ay + 2 GROUP BY ALL)"


@query(f"WITH {AP_SQL} SELECT frame_id, avg(score) AS score FROM ap_scores GROUP BY frame_id")
def local_gradient_score(spark, sf):
    return fr.local_gradient_score(frames(spark, sf), APS, 4)


@query(f"WITH {AP_SQL} SELECT frame_id, ap_id, score FROM ap_scores")
def ap_score_matrix(spark, sf):
    return fr.ap_scores(frames(spark, sf), APS, 4)


@query()
def ap_score_matrix_log(spark, sf):
    return fr.log_ap_scores(frames(spark, sf), APS, 4, 1.2)


@query(f"""WITH {SCORES_SQL}, k AS (SELECT frame_id, file_id, CASE WHEN frame_id % 2 = 0 THEN score END AS s FROM scores),
f AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN frame_id END IGNORE NULLS) OVER b AS x0, last_value(s IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN s IS NOT NULL THEN frame_id END IGNORE NULLS) OVER a AS x1, first_value(s IGNORE NULLS) OVER a AS y1 FROM k
 WINDOW b AS (PARTITION BY file_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY file_id ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT frame_id, file_id, coalesce(s, y0 + (y1 - y0) * (frame_id - x0) / (x1 - x0), y0, y1) AS filled FROM f""")
def interp_scores(spark, sf):
    half = scores(spark, sf).withColumn("s", F.when(F.col("frame_id") % 2 == 0, F.col("score")))
    return fr.interpolated(half, "file_id", "frame_id", "s").select("frame_id", "file_id", "filled")


@query(f"""WITH {PIXELS_SQL}, q AS (SELECT frame_id, filter, y, x, floor(v * 255) AS u FROM pixels), held AS (SELECT frame_id, list(u ORDER BY y, x) AS l FROM q GROUP BY 1), lp AS (SELECT q.frame_id, filter, var_pop({LAPLACIAN}) AS s FROM q JOIN held USING (frame_id) GROUP BY ALL)
SELECT frame_id, s / CASE WHEN max(s) OVER (PARTITION BY filter) > 0 THEN max(s) OVER (PARTITION BY filter) ELSE 1 END AS score FROM lp""")
def series_score(spark, sf):
    import numpy as np

    raw = fr.per_stack(frames(spark, sf), lambda a, _: {"s": kernels.laplacian(np.floor(a * 255)).var((1, 2))}, "s double", ("frame_id", "filter"))
    top = raw.groupBy("filter").agg(F.max("s").alias("top"))
    return raw.join(top, "filter").select("frame_id", (F.col("s") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("score"))


@query(f"WITH {SCORES_SQL} SELECT file_id, stddev_pop(score) / avg(score) AS cv FROM scores GROUP BY file_id")
def score_cv(spark, sf):
    return scores(spark, sf).groupBy("file_id").agg((F.stddev_pop("score") / F.avg("score")).alias("cv"))


@query(f"WITH {PIXELS_SQL} SELECT frame_id, count(*) FILTER (floor(v * 255) > 127) AS n, avg(x) FILTER (floor(v * 255) > 127) AS cx, avg(y) FILTER (floor(v * 255) > 127) AS cy FROM pixels GROUP BY frame_id")
def disk_moments(spark, sf):
    return fr.disk_moments(frames(spark, sf))


@query()
def disk_ellipse(spark, sf):
    return fr.disk_ellipse(frames(spark, sf))


ELEMENT_SQL = "k AS (SELECT dy, dx FROM (VALUES " + ", ".join(f"({dy}, {reach})" for dy, reach in contours.round_element()) + ") r(dy, reach), range(-3, 4) s(dx) WHERE abs(dx) <= reach)"


@query(f"""WITH {PIXELS_SQL}, {ELEMENT_SQL}, m AS (SELECT frame_id, y, x, floor(v * 255) > 127 AS lit FROM pixels),
big AS (SELECT m.frame_id, m.y, m.x, bool_or(o.lit) AS lit FROM m, k JOIN m o ON o.frame_id = m.frame_id AND o.y = m.y + dy AND o.x = m.x + dx GROUP BY ALL),
done AS (SELECT b.frame_id, b.y, b.x, bool_and(o.lit) AS lit FROM big b, k JOIN big o ON o.frame_id = b.frame_id AND o.y = b.y + dy AND o.x = b.x + dx GROUP BY ALL)
SELECT frame_id, count(*) FILTER (m.lit) AS n_lit, count(*) FILTER (d.lit) AS n_closed, string_agg(CAST(CAST(d.lit AS INTEGER) AS VARCHAR), '' ORDER BY y, x) AS closed FROM m JOIN done d USING (frame_id, y, x) GROUP BY frame_id""")
def disk_closing(spark, sf):
    return fr.closed_disks(frames(spark, sf), fixed=127)


MEDIAN_SQL = "mid AS (SELECT frame_id, v, avg(v) OVER (PARTITION BY frame_id) AS m FROM pixels WHERE y >= 2 AND y < 6 AND x >= 2 AND x < 6), med AS (SELECT frame_id, quantile_cont(v, 0.5) AS median FROM mid WHERE v > 0.3 * m GROUP BY frame_id)"


@query(f"WITH {PIXELS_SQL}, {MEDIAN_SQL} SELECT frame_id, median FROM med")
def disk_median(spark, sf):
    return stack.disk_median(pix(spark, sf), ["frame_id"])


@query(f"WITH {PIXELS_SQL} SELECT frame_id, y, x, 0.2126 * v + 0.7152 * v * v + 0.0722 * v / 2 AS lum FROM pixels")
def luminance(spark, sf):
    v = F.col("v")
    return pix(spark, sf).select("frame_id", "y", "x", fr.luminance(v, v * v, v / 2).alias("lum"))


@query(f"""WITH {METRICS_SQL}, r AS (SELECT *, 0.5 * laplacian + 0.3 * tenengrad + 0.2 * norm_variance AS raw FROM metrics), s AS (SELECT *, (raw - min(raw) OVER f) / CASE WHEN max(raw) OVER f > min(raw) OVER f THEN max(raw) OVER f - min(raw) OVER f ELSE 1 END AS norm FROM r WINDOW f AS (PARTITION BY filter))
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, filter, CAST(frame_id AS VARCHAR) AS stem, abs(laplacian - round(laplacian, 2)) <= 0.005 AS laplacian_ok, round(norm_variance, 6) AS norm_variance, round(raw, 4) AS raw_score, round(norm, 6) AS norm_score FROM s""")
def quality_scores_csv(spark, sf):
    """Scores of every frame written as CSV with all metrics, and read back."""
    m = metrics(spark, sf).select("ts", "filter", F.col("frame_id").cast("string").alias("stem"), "laplacian", "tenengrad", "norm_variance")
    scored = norm_scores(m.withColumn("raw_score", raw_score(F.col("laplacian"), F.col("tenengrad"), F.col("norm_variance"))))
    path = f"{shared_dir(spark)}/scores/{uuid.uuid4().hex}"
    report.score_sink(scored, path)
    back = spark.read.schema("ts timestamp_ntz, filter string, stem string, laplacian double, tenengrad double, norm_variance double, raw_score double, norm_score double").option("header", True).csv(path)
    return back.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "filter", "stem", (F.round("laplacian", 2) == F.col("laplacian")).alias("laplacian_ok"), "norm_variance", "raw_score", "norm_score")


# -- selection ----------------------------------------------------------------------------------------------------------
RANKED_SQL = SCORES_SQL + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, frame_id DESC) AS place, row_number() OVER (PARTITION BY file_id ORDER BY score, frame_id) AS low, count(*) OVER (PARTITION BY file_id) AS n FROM scores), chosen AS (SELECT * FROM ranked WHERE place <= least(greatest(5, CAST(floor(n * 0.1) AS INTEGER)), n))"


@query(f"WITH {RANKED_SQL} SELECT file_id, frame_id, CAST(place AS INTEGER) AS place FROM chosen")
def select_top_percent(spark, sf):
    return stack.select_top(scores(spark, sf), "file_id", 0.1, 5).select("file_id", "frame_id", "place")


@query(f"WITH {FRAMES_SQL} SELECT file_id, count(*) AS n, count(*) >= 50 AS enough FROM frames GROUP BY file_id")
def min_frames_gate(spark, sf):
    return frames(spark, sf).groupBy("file_id").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 50)


@query(f"WITH {RANKED_SQL} SELECT file_id, frame_id FROM ranked WHERE low - 1 >= greatest(0, least(CAST(floor(n * 0.75) AS INTEGER) - 5, n - 10)) AND low - 1 < greatest(0, least(CAST(floor(n * 0.75) AS INTEGER) - 5, n - 10)) + 10")
def reference_band(spark, sf):
    return stack.reference_band(scores(spark, sf), "file_id", 10).select("file_id", "frame_id")


@query(f"WITH {RANKED_SQL} SELECT file_id, frame_id FROM ranked WHERE low <= floor(n * 0.25) AND frame_id NOT IN (SELECT frame_id FROM chosen)")
def noise_floor_frames(spark, sf):
    s = scores(spark, sf)
    return stack.noise_floor_frames(s, stack.select_top(s, "file_id", 0.1, 5), "file_id").select("file_id", "frame_id")


@query(f"WITH {AP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ap_id ORDER BY score DESC, frame_id) AS place, count(*) OVER (PARTITION BY ap_id) AS n FROM ap_scores) SELECT ap_id, frame_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= greatest(3, floor(n * 0.1))")
def per_ap_top(spark, sf):
    return stack.per_ap_top(fr.ap_scores(frames(spark, sf), APS, 4), ["ap_id"], 0.1).select("ap_id", "frame_id", "place")


@query(f"WITH {PIXELS_SQL}, aps AS (SELECT CAST(a * 2 AS INTEGER) AS ax, CAST(b * 2 AS INTEGER) AS ay FROM range(1, 4) p(a), range(1, 4) q(b)), g AS (SELECT frame_id, ax, ay, stddev_pop(v) AS s, avg(v) AS m FROM pixels JOIN aps ON x >= ax - 2 AND x < ax + 2 AND y >= ay - 2 AND y < ay + 2 GROUP BY ALL) SELECT frame_id, ax, ay FROM g JOIN (SELECT frame_id, max(v) AS p FROM pixels GROUP BY 1) USING (frame_id) WHERE s >= 0.055 AND m >= 0.75 * p")
def ap_grid_uniform(spark, sf):
    return grids.ap_grid(frames(spark, sf), 2, 4, 0.055, 0.75, to_the_end=True)


GRID_SQL = PIXELS_SQL + """, d AS (SELECT frame_id, sum(x) / count(*) AS cx, sum(y) / count(*) AS cy, sqrt(count(*) / pi()) AS radius FROM pixels WHERE floor(v * 255) > 127 GROUP BY frame_id),
g AS (SELECT frame_id, ax, ay, stddev_pop(v) AS s, avg(v) AS m FROM pixels JOIN (SELECT CAST(a AS INTEGER) AS ax, CAST(b AS INTEGER) AS ay FROM range(2, 6) p(a), range(2, 6) q(b)) ON x >= ax - 2 AND x < ax + 2 AND y >= ay - 2 AND y < ay + 2 GROUP BY ALL)"""


@query(f"WITH {GRID_SQL} SELECT CAST(frame_id AS VARCHAR) AS frame_id, ax, ay FROM g LEFT JOIN d USING (frame_id) JOIN (SELECT frame_id, max(v) AS p FROM pixels GROUP BY 1) USING (frame_id) WHERE s >= 0.05 AND m >= 0.6 * p AND coalesce((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy) < radius * radius, true)")
def ap_grid_function(spark, sf):
    """The table function in SQL: points on the disk that the lit pixels' centre and number give."""
    from lumastack.functions.sql import register_functions

    register_functions(spark)
    lit = F.filter(F.transform("px", lambda v, i: F.when(F.floor(v * 255) > 127, i)), lambda i: i.isNotNull())
    n, add = F.size("_lit"), lambda s, v: s + v
    rows = frames(spark, sf).withColumn("_lit", lit)
    mean = lambda f: F.try_divide(F.aggregate(F.transform("_lit", f), F.lit(0).cast("bigint"), add), n)
    rows = rows.select("frame_id", "h", "w", "px", mean(lambda i: (i % F.col("w")).cast("bigint")).alias("cx"), mean(lambda i: F.floor(i / F.col("w"))).alias("cy"), F.when(n > 0, F.sqrt(n / F.pi())).alias("radius"))
    rows.createOrReplaceTempView("ap_grid_frames")
    return spark.sql("SELECT * FROM ap_grid(TABLE(SELECT * FROM ap_grid_frames), 1, 4, 0.05D, 0.6D)")


@query()
def ap_grid_poisson(spark, sf):
    return fr.poisson_grid(frames(spark, sf), 4, 0.5)


@query(f"WITH {PIXELS_SQL}, g AS (SELECT s * 2 AS size, CAST(s + 2 * a AS INTEGER) AS ax, CAST(s + 2 * b AS INTEGER) AS ay FROM range(1, 4) z(s), range(4) p(a), range(4) q(b) WHERE s + 2 * a <= 8 - s AND s + 2 * b <= 8 - s), m AS (SELECT frame_id, ax, ay, size, stddev_pop(v) AS d, avg(v) AS m FROM pixels JOIN g ON x >= ax - size / 2 AND x < ax + size / 2 AND y >= ay - size / 2 AND y < ay + size / 2 GROUP BY ALL) SELECT frame_id, ax, ay, CAST(size AS INTEGER) AS size FROM m JOIN (SELECT frame_id, max(v) AS p FROM pixels GROUP BY 1) USING (frame_id) WHERE d >= 0.05 AND m >= 0.7 * p")
def ap_grid_layers(spark, sf):
    f = frames(spark, sf)
    layers = [grids.ap_grid(f, 2, size, 0.05, 0.7, to_the_end=True).withColumn("size", F.lit(size)) for size in (2, 4, 6)]
    return layers[0].unionByName(layers[1]).unionByName(layers[2])


# -- geometry -----------------------------------------------------------------------------------------------------------
POINTS_SQL = AP_SQL + ", points AS (SELECT frame_id, ax, ay, score - 0.1 AS dx, 0.1 - score / 2 AS dy, 0.5 + 0.05 * ap_id AS conf FROM ap_scores JOIN aps USING (ap_id))"


def points(spark, sf) -> DataFrame:
    at_ = F.array(*[F.struct(F.lit(x).alias("ax"), F.lit(y).alias("ay")) for x, y in APS])
    s = fr.ap_scores(frames(spark, sf), APS, 4).withColumn("p", F.get(at_, F.col("ap_id")))
    return s.select("frame_id", "p.ax", "p.ay", (F.col("score") - 0.1).alias("dx"), (0.1 - F.col("score") / 2).alias("dy"), (0.5 + 0.05 * F.col("ap_id")).alias("conf"))


@query(f"""WITH {POINTS_SQL}, f AS (SELECT p.frame_id, CAST(b AS INTEGER) AS y, CAST(a AS INTEGER) AS x, exp(-((a - ax) ** 2 + (b - ay) ** 2) / (2 * 1.8 * 1.8)) AS g, dx, dy, conf AS c FROM points p, range(8) r(a), range(8) s(b) WHERE abs(a - ax) <= 6 AND abs(b - ay) <= 6),
w AS (SELECT frame_id, y, x, sum(g * c) AS w, sum(g * dx * c * c) AS sx, sum(g * dy * c * c) AS sy FROM f GROUP BY ALL), t AS (SELECT *, max(w) OVER (PARTITION BY frame_id) AS top FROM w)
SELECT frame_id, y, x, CASE WHEN w >= 0.05 * top THEN sx / w ELSE 0 END AS dx, CASE WHEN w >= 0.05 * top THEN sy / w ELSE 0 END AS dy FROM t""")
def warp_field(spark, sf):
    return fields.warp_field(points(spark, sf), SIDE, SIDE, 1.8)


@query()
def warp_field_sharpness(spark, sf):
    """The adaptive field: a point's weight is its confidence times log(1 + the sharpness of its patch), spread further."""
    sharp = fr.patch_sharpness(frames(spark, sf), APS, 4)
    at_ = F.array(*[F.struct(F.lit(x).alias("ax"), F.lit(y).alias("ay")) for x, y in APS])
    sharp = sharp.withColumn("p", F.get(at_, F.col("ap_id"))).select("frame_id", "p.ax", "p.ay", "sharpness")
    weighed = points(spark, sf).join(sharp, ["frame_id", "ax", "ay"]).withColumn("conf", F.col("conf") * F.log1p("sharpness")).drop("sharpness")
    return fields.warp_field(weighed, SIDE, SIDE, 64.0)


@query(f"WITH {POINTS_SQL} SELECT frame_id, ax, ay, conf >= 0.6 AND sqrt(dx * dx + dy * dy) <= 0.2 AS ok FROM points")
def confidence_gate(spark, sf):
    return points(spark, sf).select("frame_id", "ax", "ay", stack.gated(F.col("conf"), F.col("dx"), F.col("dy"), 0.6, 0.2).alias("ok"))


@query(f"""WITH {PIXELS_SQL}, d AS (SELECT frame_id, y, x, 0.8 * radians((frame_id % 7) / 10.0) * sqrt(greatest(0, (1.05 * 3) ** 2 - (x - 3.5) ** 2 - ((y - 3.5) / 0.9) ** 2)) AS drift, radians(25.0) AS p FROM pixels) SELECT frame_id, y, x, drift * cos(p) AS dx, drift * sin(p) AS dy FROM d""")
def derotation_field(spark, sf):
    field = stack.derotation_field(F.col("x"), F.col("y"), 3.5, 3.5, 3.0, 0.9, (F.col("frame_id") % 7) / 10.0, F.lit(25.0))
    return pix(spark, sf).withColumn("d", field).select("frame_id", "y", "x", "d.dx", "d.dy")


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT frame_id, y, x, x - 3.5 AS rx, y - 3.5 AS ry, radians(25.0) AS p, 45.0 * (frame_id - 100) / (9.9281 * 3600) * 360 AS delta FROM pixels),
d AS (SELECT frame_id, y, x, p, 0.8 * radians(delta) * sqrt(greatest(0, (1.05 * 3) ** 2 - (rx * cos(p) + ry * sin(p)) ** 2 - ((ry * cos(p) - rx * sin(p)) / 0.9) ** 2)) AS drift FROM c) SELECT frame_id, y, x, drift * cos(p) AS dx, drift * sin(p) AS dy FROM d""")
def derotation_field_tilted(spark, sf):
    delta = stack.rotation_delta(45.0 * (F.col("frame_id") - 100), 9.9281)
    field = stack.derotation_field(F.col("x"), F.col("y"), 3.5, 3.5, 3.0, 0.9, delta, F.lit(25.0), tilted=True)
    return pix(spark, sf).withColumn("d", field).select("frame_id", "y", "x", "d.dx", "d.dy")


@query(f"WITH {FRAMES_SQL} SELECT frame_id, 45.0 * frame_id / (9.925 * 3600) * 360 AS delta FROM frames")
def rotation_delta(spark, sf):
    return frames(spark, sf).select("frame_id", stack.rotation_delta(45.0 * F.col("frame_id"), 9.925).alias("delta"))


EPHEMERIS_SQL = "eph AS (SELECT DATE '2024-01-01' + CAST(d AS INTEGER) AS date, (350 + CAST(0.7 AS DOUBLE) * (d + 1)) % 360 AS v FROM range(31) r(d))"


def ephemeris(spark) -> DataFrame:
    return spark.range(31).select(F.lit("599").alias("body"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.pmod(350 + 0.7 * (F.col("id") + 1), F.lit(360.0)).alias("angle"))


@query(f"""WITH {EPHEMERIS_SQL}, j AS (SELECT event_id, ts, a.v AS v0, b.v AS v1, (hour(ts) * 60 + minute(ts)) / 1440.0 AS part FROM events LEFT JOIN eph a ON CAST(ts AS DATE) = a.date LEFT JOIN eph b ON CAST(ts AS DATE) + 1 = b.date),
t AS (SELECT *, CASE WHEN (v1 - v0 + 180.0) % 360 < 0 THEN ((v1 - v0 + 180.0) % 360 + 360) % 360 ELSE (v1 - v0 + 180.0) % 360 END - 180.0 AS turn FROM j), p AS (SELECT *, v0 + part * turn AS a FROM t)
SELECT event_id, CASE WHEN v0 IS NULL THEN 0 WHEN v1 IS NULL THEN v0 WHEN a % 360 < 0 THEN (a % 360 + 360) % 360 ELSE a % 360 END AS pole FROM p""")
def pole_angle_lookup(spark, sf):
    times = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    return stack.pole_angle(times, ephemeris(spark), "599").select("event_id", "pole")


CENTER_SQL = PIXELS_SQL + ", centers AS (SELECT frame_id, file_id, filter, ts, sum(x * v) / sum(v) AS cx, sum(y * v) / sum(v) AS cy FROM pixels GROUP BY ALL)"


def centers(spark, sf) -> DataFrame:
    return pix(spark, sf).groupBy("frame_id", "file_id", "filter", "ts").agg((F.sum(F.col("x") * F.col("v")) / F.sum("v")).alias("cx"), (F.sum(F.col("y") * F.col("v")) / F.sum("v")).alias("cy"))


@query(f"WITH {CENTER_SQL} SELECT frame_id, CASE WHEN abs(3.5 - cx) > 0.1 OR abs(3.5 - cy) > 0.1 THEN 0 ELSE 3.5 - cx END AS dx, CASE WHEN abs(3.5 - cx) > 0.1 OR abs(3.5 - cy) > 0.1 THEN 0 ELSE 3.5 - cy END AS dy FROM centers".replace("> 0.1", "> 15"))
def limb_shift(spark, sf):
    return centers(spark, sf).withColumn("s", stack.limb_shift(F.col("cx"), F.col("cy"), F.lit(10.0), 3.5, 3.5)).select("frame_id", "s.dx", "s.dy")


@query(f"WITH {CENTER_SQL} SELECT frame_id, CASE WHEN frame_id % 3 = 0 THEN cx ELSE 3.5 - cx END AS dx, CASE WHEN frame_id % 3 = 0 THEN cy ELSE 3.5 - cy END AS dy, CASE WHEN frame_id % 3 = 0 THEN 'phase' ELSE 'limb' END AS method FROM centers")
def align_fallback(spark, sf):
    limb = stack.limb_shift(F.col("cx"), F.col("cy"), F.when(F.col("frame_id") % 3 == 0, 1.0).otherwise(10.0), 3.5, 3.5)
    rows = centers(spark, sf).withColumn("limb", limb).withColumn("phase", F.struct(F.col("cx").alias("dx"), F.col("cy").alias("dy")))
    return rows.withColumn("s", stack.aligned(F.col("limb"), F.col("phase"))).select("frame_id", "s.*")


@query(f"WITH {CENTER_SQL} SELECT file_id, 4 - arg_min(cx, (o, frame_id)) AS dx, 4 - arg_min(cy, (o, frame_id)) AS dy FROM (SELECT *, list_position(['IR','R','G','CH4','B'], filter) AS o FROM centers) GROUP BY file_id")
def shared_center(spark, sf):
    return stack.shared_center(centers(spark, sf), "file_id", SIDE, SIDE)


@query(f"WITH {CENTER_SQL}, m AS (SELECT frame_id, quantile_cont(cx, 0.5) OVER w - cx AS dx, quantile_cont(cy, 0.5) OVER w - cy AS dy FROM centers WINDOW w AS (PARTITION BY file_id ORDER BY ts, frame_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT frame_id, CASE WHEN abs(dx) < 0.05 THEN 0 ELSE dx END AS dx, CASE WHEN abs(dy) < 0.05 THEN 0 ELSE dy END AS dy FROM m")
def smooth_centers(spark, sf):
    return stack.smooth_centers(centers(spark, sf), "file_id").select("frame_id", "dx", "dy")


@query(f"WITH {FRAMES_SQL} SELECT frame_id, CASE WHEN abs(45.0 * (frame_id % 50) - 0.0) < 1 THEN 0 ELSE 45.0 * (frame_id % 50) END AS dt FROM frames")
def skip_tiny_dt(spark, sf):
    dt = 45.0 * (F.col("frame_id") % 50)
    return frames(spark, sf).select("frame_id", F.when(F.abs(dt) < 1, 0.0).otherwise(dt).alias("dt"))


def reference(spark, sf) -> list[list[float]]:
    """The first frame, as rows of numbers."""
    px = frames(spark, sf).orderBy("frame_id").first()["px"]
    return [px[i : i + SIDE] for i in range(0, SIDE * SIDE, SIDE)]


@query()
def phase_shift(spark, sf):
    return fr.shifts_to(frames(spark, sf), reference(spark, sf), "phase")


@query()
def ncc_shift(spark, sf):
    return fr.shifts_to(frames(spark, sf), reference(spark, sf), "ncc", 0.15)


@query()
def phase_qsf_shift(spark, sf):
    return fr.phase_qsf_shifts(frames(spark, sf), reference(spark, sf), 0.15, 2.0)


CUBIC_SQL = "CASE WHEN abs({t}) <= 1 THEN 1.25 * abs({t}) ** 3 - 2.25 * abs({t}) ** 2 + 1 WHEN abs({t}) < 2 THEN -0.75 * abs({t}) ** 3 + 3.75 * abs({t}) ** 2 - 6 * abs({t}) + 3 ELSE 0 END"


@query(f"""WITH {LIST_SQL}, m AS (SELECT frame_id, filter, y, x, l, x + (frame_id % 3) / 2.0 AS sx, y + 0.25 AS sy FROM grid),
t AS (SELECT *, CAST(floor(sx) AS INTEGER) + i AS fx, CAST(floor(sy) AS INTEGER) + j AS fy FROM m, range(-1, 3) a(i), range(-1, 3) b(j))
SELECT frame_id, filter, y, x, greatest(0, least(1, sum(({CUBIC_SQL.format(t="(sx - fx)")}) * ({CUBIC_SQL.format(t="(sy - fy)")}) * l[greatest(0, least(7, fy)) * 8 + greatest(0, least(7, fx)) + 1]))) AS v FROM t GROUP BY frame_id, filter, y, x""")
def shift_frames(spark, sf):
    f = frames(spark, sf).select("frame_id", "filter", "h", "w", "px").withColumn("dx", (F.col("frame_id") % 3) / 2.0).withColumn("dy", F.lit(0.25))
    return as_pixels(fr.shift_frames(f)).select("frame_id", "filter", "y", "x", "v")


@query()
def derotate_frames(spark, sf):
    """Every frame turned to the middle of its file's time, about its own disk, with the pole's angle of that day."""
    f = timed_frames(spark, sf)
    f = f.withColumn("delta", stack.rotation_delta(seconds(F.col("ts")) - F.col("center_s"), 9.9281))
    return as_pixels(derotate.turned(f.select("frame_id", "h", "w", "px", "delta", "pole"))).select("frame_id", "y", "x", "v")


# -- stacks -------------------------------------------------------------------------------------------------------------
SCORED_PIX_SQL = SCORES_SQL + ", sp AS (SELECT p.*, s.score FROM pixels p JOIN scores s USING (frame_id))"


def scored_pixels(spark, sf) -> DataFrame:
    return pix(spark, sf).join(scores(spark, sf).select("frame_id", "score"), "frame_id")


@query(f"WITH {SCORED_PIX_SQL} SELECT file_id, filter, y, x, CASE WHEN count(*) = 1 THEN any_value(v) ELSE greatest(0, least(1, sum(greatest(score, 1e-9) * v) / sum(greatest(score, 1e-9)))) END AS v, count(*) AS n FROM sp GROUP BY ALL")
def weighted_stack(spark, sf):
    return stack.weighted_stack(scored_pixels(spark, sf), ["file_id", "filter"], F.col("score"))


@query(f"WITH {SCORED_PIX_SQL} SELECT file_id, y, x, CASE WHEN count(*) = 1 THEN any_value(v) ELSE greatest(0, least(1, sum(greatest(score ** 3, 1e-9) * v) / sum(greatest(score ** 3, 1e-9)))) END AS v, count(*) AS n FROM sp GROUP BY ALL")
def power_stack(spark, sf):
    return stack.power_stack(scored_pixels(spark, sf), ["file_id"], F.col("score"))


@query(f"WITH {PIXELS_SQL}, m AS (SELECT *, avg(v) OVER g AS m, stddev_pop(v) OVER g AS s FROM pixels WINDOW g AS (PARTITION BY file_id, y, x)) SELECT file_id, y, x, coalesce(avg(v) FILTER (abs(v - m) <= 2 * greatest(s, 1e-6)), any_value(m)) AS v, 1 - count(*) FILTER (abs(v - m) <= 2 * greatest(s, 1e-6)) / count(*) AS clipped FROM m GROUP BY ALL")
def sigma_clip_stack(spark, sf):
    return stack.sigma_clip_stack(pix(spark, sf), ["file_id"])


@query(f"WITH {PIXELS_SQL} SELECT filter, y, x, avg(v) AS v, count(*) AS n FROM pixels GROUP BY ALL")
def mean_stack(spark, sf):
    return stack.mean_stack(pix(spark, sf), ["filter"])


@query(f"""WITH {PIXELS_SQL.replace("pixels AS (", "pixels AS MATERIALIZED (")}, {MEDIAN_SQL.replace("med AS (", "med AS MATERIALIZED (")}, ref AS (SELECT file_id, min(frame_id) AS ref_id FROM frames GROUP BY file_id), t AS MATERIALIZED (SELECT file_id, ref_id, median AS goal FROM ref JOIN med ON frame_id = ref_id)
SELECT p.frame_id, p.y, p.x, CASE WHEN p.frame_id = ref_id OR goal < 1e-6 OR median < 1e-6 THEN v ELSE greatest(0, least(1, v * goal / median)) END AS out FROM pixels p JOIN med USING (frame_id) JOIN t USING (file_id)""")
def brightness_match(spark, sf):
    f = frames(spark, sf)
    first = f.groupBy("file_id").agg(F.min("frame_id").alias("first_id"))
    made = stack.brightness_match(f.join(first, "file_id"), F.col("frame_id") == F.col("first_id"), "file_id")
    return as_pixels(made).select("frame_id", "y", "x", F.col("v").alias("out"))


#: Spectra by plain sums; u and w are the frequencies along x and y.
DFT_SQL = "freq AS (SELECT CAST(a AS INTEGER) AS w, CAST(b AS INTEGER) AS u FROM range(8) p(a), range(8) q(b)), dft AS MATERIALIZED (SELECT frame_id, file_id, filter, w, u, sum(v * cos(2 * pi() * ((u * x + w * y) % 8) / 8)) AS re, -sum(v * sin(2 * pi() * ((u * x + w * y) % 8) / 8)) AS im FROM pixels, freq GROUP BY ALL), spec AS MATERIALIZED (SELECT *, sqrt(re * re + im * im) AS mag FROM dft)"
INVERSE_SQL = "greatest(0, least(1, sum(re * cos(2 * pi() * ((u * x + w * y) % 8) / 8) - im * sin(2 * pi() * ((u * x + w * y) % 8) / 8)) / 64))"


@query(f"""WITH {PIXELS_SQL}, {DFT_SQL}, s AS (SELECT filter, w, u, sum(mag * re) / sum(mag) AS re, sum(mag * im) / sum(mag) AS im FROM spec GROUP BY ALL), xy AS (SELECT DISTINCT y, x FROM pixels)
SELECT filter, y, x, {INVERSE_SQL} AS v FROM s, xy GROUP BY ALL""")
def fourier_stack(spark, sf):
    return as_pixels(fr.fourier_stack(frames(spark, sf), "filter")).select("filter", "y", "x", "v")


@query(f"""WITH {RANKED_SQL}, {DFT_SQL}, noise AS (SELECT frame_id FROM ranked WHERE low <= floor(n * 0.25) AND frame_id NOT IN (SELECT frame_id FROM chosen)),
fl AS (SELECT file_id, w, u, avg(mag) AS floor FROM spec WHERE frame_id IN (SELECT frame_id FROM noise) GROUP BY ALL),
k AS (SELECT s.*, greatest(score ** 2, 1e-9) * greatest(mag - coalesce(floor, 0), 0) ** 1.5 AS wt FROM spec s JOIN scores USING (frame_id) LEFT JOIN fl ON fl.file_id = s.file_id AND fl.w = s.w AND fl.u = s.u),
g AS (SELECT file_id, w, u, CASE WHEN sum(wt) > 1e-12 THEN sum(wt * re) / sum(wt) ELSE 0 END AS r0, CASE WHEN sum(wt) > 1e-12 THEN sum(wt * im) / sum(wt) ELSE 0 END AS i0, tanh(avg(mag) / (stddev_pop(mag) + 1e-9) / 2) * exp(-(pow((CASE WHEN u < 4 THEN u ELSE u - 8 END) / 8.0, 2) + pow((CASE WHEN w < 4 THEN w ELSE w - 8 END) / 8.0, 2)) / (2 * 0.2 * 0.2)) AS f FROM k GROUP BY file_id, w, u),
s AS (SELECT file_id, w, u, r0 * f AS re, i0 * f AS im FROM g), xy AS (SELECT DISTINCT y, x FROM pixels) SELECT file_id, y, x, {INVERSE_SQL} AS v FROM s, xy GROUP BY ALL""")
def fourier_stack_full(spark, sf):
    """With the score's power as factor, the noise floor of the worst frames taken off, the mask of signal to noise and the rolloff."""
    s = scores(spark, sf)
    noise = stack.noise_floor_frames(s, stack.select_top(s, "file_id", 0.1, 5), "file_id").select("frame_id")
    f = frames(spark, sf)
    floors = fr.spectra_floor(f.join(noise, "frame_id", "left_semi"), "file_id")
    scored = f.join(s.select("frame_id", "score"), "frame_id")
    return as_pixels(fr.fourier_stack(scored, "file_id", 1.5, F.pow("score", F.lit(2.0)), floors, 2.0, 0.2)).select("file_id", "y", "x", "v")


ROLLOFF_SQL = "exp(-((u * u + w * w) / (2 * 0.2 * 0.2)))"


@query(f"WITH {PIXELS_SQL}, k AS (SELECT frame_id, y, x, v, (CASE WHEN x < 4 THEN x ELSE x - 8 END) / 8.0 AS u, (CASE WHEN y < 4 THEN y ELSE y - 8 END) / 8.0 AS w FROM pixels) SELECT frame_id, y, x, v * {ROLLOFF_SQL} AS v FROM k")
def spectral_rolloff(spark, sf):
    u, w = (F.when(F.col(c) < 4, F.col(c)).otherwise(F.col(c) - 8) / 8.0 for c in ("x", "y"))
    return pix(spark, sf).select("frame_id", "y", "x", (F.col("v") * F.exp(-((u * u + w * w) / (2 * 0.2 * 0.2)))).alias("v"))


def timed_frames(spark, sf) -> DataFrame:
    """Frames with score, the middle of their file's time (center_s) and the pole's angle on that day."""
    f = frames(spark, sf).join(scores(spark, sf).select("frame_id", "score"), "frame_id")
    s = seconds(F.col("ts"))
    middle = f.groupBy("file_id").agg(((F.min(s) + F.max(s)) / 2).alias("center_s"))
    poles = stack.pole_angle(middle.withColumn("ts", F.timestamp_seconds("center_s").cast("timestamp_ntz")), ephemeris(spark), "599").select("file_id", "center_s", "pole")
    return f.join(poles, "file_id")


@query()
def derotate_stack(spark, sf):
    stacked, _ = derotate.derotate_stack(timed_frames(spark, sf), ["file_id", "filter"], "center_s", "pole", 0.3)
    return as_pixels(stacked).select("file_id", "filter", "y", "x", "v", "n")


@query()
def derotate_log(spark, sf):
    _, log = derotate.derotate_stack(timed_frames(spark, sf), ["file_id", "filter"], "center_s", "pole", 0.3)
    return log.drop("ts")


STACKED_SQL = SCORES_SQL + ", k AS (SELECT s.*, score >= 0.3 OR NOT bool_or(score >= 0.3) OVER (PARTITION BY file_id, filter) AS kept, (min(epoch(ts)) OVER (PARTITION BY file_id) + max(epoch(ts)) OVER (PARTITION BY file_id)) / 2 AS c FROM scores s)"


@query(f"""WITH {STACKED_SQL} SELECT frame_id, file_id, filter, round(epoch(ts) - c, 2) AS dt_sec, round((epoch(ts) - c) / (9.9281 * 3600) * 360, 4) AS delta_lambda_deg, row_number() OVER (PARTITION BY file_id, filter ORDER BY abs(epoch(ts) - c), ts, frame_id) = 1 AS is_reference FROM k WHERE kept""")
def derotate_selection(spark, sf):
    """Which frames are stacked, how far they are turned and which one is the reference: the part of the log that needs no resampling."""
    _, log = derotate.derotate_stack(timed_frames(spark, sf), ["file_id", "filter"], "center_s", "pole", 0.3)
    return log.select("frame_id", "file_id", "filter", "dt_sec", "delta_lambda_deg", "is_reference")


# -- wavelets and tone --------------------------------------------------------------------------------------------------
L1_SQL = LIST_SQL + f", s1 AS (SELECT frame_id, y, x, v, {taps_sql(kernels.B3)} AS s FROM grid), h1 AS (SELECT frame_id, list(s ORDER BY y, x) AS l FROM s1 GROUP BY 1), s2 AS (SELECT s1.*, {taps_sql(kernels.B3, 2)} AS r FROM s1 JOIN h1 USING (frame_id)), details AS (SELECT frame_id, 0 AS level, y, x, v - s AS v FROM s2 UNION ALL SELECT frame_id, 1, y, x, s - r FROM s2 UNION ALL SELECT frame_id, 2, y, x, r FROM s2)"


def details(spark, sf) -> DataFrame:
    """(frame_id, level, y, x, v): two levels of detail and the rest."""
    made = None
    for level in range(3):
        one = as_pixels(fr.with_px(frames(spark, sf), lambda a, level=level: kernels.atrous(a, 2)[level])).select("frame_id", F.lit(level).alias("level"), "y", "x", "v")
        made = one if made is None else made.unionByName(one)
    return made


@query(f"WITH {L1_SQL} SELECT frame_id, level, y, x, v FROM details")
def atrous_decompose(spark, sf):
    return details(spark, sf)


@query("SELECT i AS level, (amount / 200.0) * gain AS weight FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([29.15, 9.48, 0.0, 0.0, 0.0, 0.0]) AS gain), (SELECT avg(value) AS amount FROM events)")
def wavelet_gains(spark, sf):
    amount = spark.read.parquet(f"{sf}/events.parquet").agg(F.avg("value").alias("amount"))
    gains = F.array(*[F.lit(g) for g in kernels.GAINS])
    return amount.select("amount", F.posexplode(gains).alias("level", "gain")).select("level", (F.col("amount") / 200.0 * F.col("gain")).alias("weight"))


@query(f"WITH {L1_SQL} SELECT frame_id, level, quantile_cont(abs(v), 0.5) / 0.6745 AS sigma FROM details WHERE level < 2 GROUP BY ALL")
def mad_sigma(spark, sf):
    return composite.mad_sigma(details(spark, sf).where("level < 2"), ["frame_id", "level"])


@query(f"WITH {L1_SQL}, n AS (SELECT frame_id, quantile_cont(abs(v), 0.5) / 0.6745 AS sigma FROM details WHERE level = 0 GROUP BY ALL) SELECT frame_id, y, x, sign(v) * greatest(abs(v) - 0.1 * sigma, 0) AS v FROM details JOIN n USING (frame_id) WHERE level = 0")
def soft_threshold(spark, sf):
    d = details(spark, sf).where("level = 0")
    n = composite.mad_sigma(d, ["frame_id"])
    return d.join(n, "frame_id").select("frame_id", "y", "x", composite.soft_threshold(F.col("v"), 0.1 * F.col("sigma")).alias("v"))


@query(f"WITH {L1_SQL} SELECT a.frame_id, a.y, a.x, greatest(0, least(1, p.v + 0.5 * 29.15 * a.v + 0.25 * 9.48 * b.v)) AS v FROM details a JOIN details b ON a.frame_id = b.frame_id AND a.y = b.y AND a.x = b.x AND b.level = 1 JOIN pixels p ON p.frame_id = a.frame_id AND p.y = a.y AND p.x = a.x WHERE a.level = 0")
def sharpen(spark, sf):
    return as_pixels(fr.with_px(frames(spark, sf), lambda a: kernels.sharpen(a, [100.0, 50.0]))).select("frame_id", "y", "x", "v")


@query()
def sharpen_denoised(spark, sf):
    return as_pixels(fr.with_px(frames(spark, sf), lambda a: kernels.sharpen(a, [100.0, 50.0], denoise=0.1))).select("frame_id", "y", "x", "v")


@query(f"WITH {PIXELS_SQL} SELECT frame_id, y, x, v * CASE WHEN least(x, 7 - x, y, 7 - y) >= 2 THEN 1 ELSE 0.5 * (1 - cos(pi() * least(x, 7 - x, y, 7 - y) / 2)) END AS v FROM pixels")
def border_taper(spark, sf):
    return pix(spark, sf).select("frame_id", "y", "x", (F.col("v") * composite.border_taper(F.col("x"), F.col("y"), SIDE, SIDE, 2)).alias("v"))


@query(f"WITH {PIXELS_SQL} SELECT frame_id, y, x, greatest(0, least(1, (v - 0.3) / 0.4)) ** (1 / 1.2) AS v FROM pixels")
def levels_adjust(spark, sf):
    return pix(spark, sf).select("frame_id", "y", "x", composite.levels_adjust(F.col("v"), 0.3, 0.7, 1.2).alias("v"))


def mosaic_sql(color: str) -> str:
    """SQL for one colour of an RGGB mosaic: the pixel itself if it has it, else the weighted mean of those around that have."""
    held = {"R": (0,), "G": (1, 2), "B": (3,)}[color]
    has = lambda dy, dx: f"(((y + {dy + 2}) % 2) * 2 + (x + {dx + 2}) % 2) IN {held if len(held) > 1 else f'({held[0]})'}"
    near = [(dy, dx, float((2 - abs(dy)) * (2 - abs(dx)))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    total = " + ".join(f"CASE WHEN {has(dy, dx)} THEN {w} * {at(dy, dx)} ELSE 0 END" for dy, dx, w in near)
    weight = " + ".join(f"CASE WHEN {has(dy, dx)} THEN {w} ELSE 0 END" for dy, dx, w in near)
    return f"SELECT frame_id, y, x, '{color}' AS c, CASE WHEN {has(0, 0)} THEN v ELSE ({total}) / ({weight}) END AS v FROM grid"


@query(f"WITH {LIST_SQL} " + " UNION ALL ".join(map(mosaic_sql, "RGB")))
def debayer(spark, sf):
    made = fr.per_stack(frames(spark, sf), lambda a, _: {"rgb": kernels.debayer(a).reshape(len(a), -1)}, "rgb array<double>")
    return made.select("frame_id", F.posexplode("rgb").alias("i", "v")).select("frame_id", F.expr("cast(i div 24 as int)").alias("y"), F.expr("cast(i div 3 as int) % 8").alias("x"), F.element_at(F.array(*map(F.lit, "RGB")), F.col("i") % 3 + 1).alias("c"), "v")


# -- composites ---------------------------------------------------------------------------------------------------------
WIDE_SQL = PIXELS_SQL + ", ch AS (SELECT file_id, filter, y, x, avg(v) AS v FROM pixels GROUP BY ALL), spec AS (SELECT * FROM (VALUES ('RGB', 'R', 'R'), ('RGB', 'G', 'G'), ('RGB', 'B', 'B'), ('IR-RGB', 'L', 'IR'), ('IR-RGB', 'R', 'R'), ('IR-RGB', 'G', 'G'), ('IR-RGB', 'B', 'B'), ('CH4-G-IR', 'R', 'CH4'), ('CH4-G-IR', 'G', 'G'), ('CH4-G-IR', 'B', 'IR')) t(name, role, filter)), need AS (SELECT name, count(*) AS need FROM spec GROUP BY name), ok AS (SELECT file_id, name FROM (SELECT DISTINCT file_id, filter FROM ch) JOIN spec USING (filter) JOIN need USING (name) GROUP BY file_id, name, need HAVING count(*) = need), wide AS (SELECT file_id, name, y, x, avg(v) FILTER (role = 'R') AS r, avg(v) FILTER (role = 'G') AS g, avg(v) FILTER (role = 'B') AS b, avg(v) FILTER (role = 'L') AS l FROM ch JOIN spec USING (filter) JOIN ok USING (file_id, name) GROUP BY ALL)"


def channels(spark, sf) -> DataFrame:
    return pix(spark, sf).groupBy("file_id", "filter", "y", "x").agg(F.avg("v").alias("v"))


def composites(spark, sf) -> DataFrame:
    return composite.compose_rgb(channels(spark, sf), "file_id")


@query(f'WITH {WIDE_SQL} SELECT file_id, name, y, x, r AS "R", g AS "G", b AS "B", l AS "L" FROM wide')
def compose_rgb(spark, sf):
    return composites(spark, sf)


@query(f"WITH {PIXELS_SQL}, p AS (SELECT frame_id, filter, y, x, v, quantile_cont(v, 0.01) OVER (PARTITION BY frame_id) AS lo, quantile_cont(v, 0.99) OVER (PARTITION BY frame_id) AS hi FROM pixels) SELECT frame_id, y, x, CASE WHEN hi > lo THEN greatest(0, least(1, (v - lo) / (hi - lo))) * 0.9 ELSE 0 END AS out FROM p")
def stretch_independent(spark, sf):
    return composite.stretched(pix(spark, sf), ["frame_id"], 0.01, 0.99, 0.9).select("frame_id", "y", "x", "out")


@query(f"WITH {PIXELS_SQL}, q AS (SELECT file_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM pixels GROUP BY 1) SELECT frame_id, y, x, CASE WHEN hi > lo THEN greatest(0, least(1, (v - lo) / (hi - lo))) ELSE greatest(0, least(1, v - lo)) END AS out FROM pixels JOIN q USING (file_id)")
def stretch_joint(spark, sf):
    return composite.stretched(pix(spark, sf), ["file_id", "filter"], 0.01, 0.99, joint=True).select("frame_id", "y", "x", "out")


def lab_sql(r: str, g: str, b: str) -> str:
    lin = [f"(CASE WHEN {c} > 0.04045 THEN (({c} + 0.055) / 1.055) ** 2.4 ELSE {c} / 12.92 END)" for c in (r, g, b)]
    rows = ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754))
    xyz = [f"(({m[0]} * {lin[0]} + {m[1]} * {lin[1]} + {m[2]} * {lin[2]}) / {m[3]})" for m in rows]
    f = [f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116 END)" for t in xyz]
    return f"CASE WHEN {xyz[1]} > 0.008856 THEN 116 * cbrt({xyz[1]}) - 16 ELSE 903.3 * {xyz[1]} END AS lab_l, 500 * ({f[0]} - {f[1]}) AS lab_a, 200 * ({f[1]} - {f[2]}) AS lab_b"


@query(f"WITH {WIDE_SQL} SELECT file_id, name, y, x, {lab_sql('r', 'g', 'b')} FROM wide")
def rgb_to_lab(spark, sf):
    c = composites(spark, sf).withColumn("lab", composite.rgb_to_lab(F.col("R"), F.col("G"), F.col("B")))
    return c.select("file_id", "name", "y", "x", F.col("lab.l").alias("lab_l"), F.col("lab.a").alias("lab_a"), F.col("lab.b").alias("lab_b"))


@query(f"WITH {WIDE_SQL} SELECT file_id, name, y, x, abs(r - r) < 0.001 AS r, abs(g - g) < 0.001 AS g, abs(b - b) < 0.001 AS b FROM wide")
def lab_round_trip(spark, sf):
    c = composites(spark, sf).withColumn("lab", composite.rgb_to_lab(F.col("R"), F.col("G"), F.col("B")))
    back = c.withColumn("rgb", composite.lab_to_rgb(F.col("lab.l"), F.col("lab.a"), F.col("lab.b")))
    return back.select("file_id", "name", "y", "x", *[(F.abs(F.col(f"rgb.{k}") - F.col(k.upper())) < 0.001).alias(k) for k in "rgb"])


def rgb_sql(light: str, a: str, b: str) -> str:
    """SQL for r, g, b of Lab, the inverse of lab_sql."""
    big = f"({light} > 7.9996)"
    y = f"(CASE WHEN {big} THEN pow(({light} + 16) / 116.0, 3) ELSE {light} / 903.3 END)"
    fy = f"(CASE WHEN {big} THEN ({light} + 16) / 116.0 ELSE 7.787 * {light} / 903.3 + 16.0 / 116 END)"
    back = lambda f: f"(CASE WHEN {f} > 0.206893 THEN pow({f}, 3) ELSE ({f} - 16.0 / 116) / 7.787 END)"
    x, z = back(f"({fy} + {a} / 500.0)") + " * 0.950456", back(f"({fy} - {b} / 200.0)") + " * 1.088754"
    rows = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
    lin = [f"({m[0]} * {x} + ({m[1]}) * {y} + ({m[2]}) * {z})" for m in rows]
    return ", ".join(f"greatest(0, least(1, CASE WHEN {c} > 0.0031308 THEN 1.055 * pow(greatest({c}, 0), 1 / 2.4) - 0.055 ELSE 12.92 * {c} END)) AS {n}" for c, n in zip(lin, ('"R"', '"G"', '"B"'), strict=True))


@query(f"WITH {WIDE_SQL}, lab AS (SELECT file_id, name, y, x, l, {lab_sql('r', 'g', 'b')} FROM wide), m AS (SELECT *, 0.7 * l * 100 + (1 - 0.7) * lab_l AS lt FROM lab WHERE l IS NOT NULL) SELECT file_id, name, y, x, {rgb_sql('lt', 'lab_a', 'lab_b')} FROM m")
def compose_lrgb(spark, sf):
    return composite.compose_lrgb(composites(spark, sf), 0.7)


@query(f"WITH {WIDE_SQL}, lab AS (SELECT file_id, name, y, x, {lab_sql('r', 'g', 'b')} FROM wide) SELECT file_id, name, y, x, {rgb_sql('lab_l * 0.9', 'lab_a * 1.5', 'lab_b * 1.5')} FROM lab")
def lab_to_rgb(spark, sf):
    """Colours made stronger and a little darker in Lab, and back."""
    c = composites(spark, sf).withColumn("lab", composite.rgb_to_lab(F.col("R"), F.col("G"), F.col("B")))
    back = c.withColumn("rgb", composite.lab_to_rgb(F.col("lab.l") * 0.9, F.col("lab.a") * 1.5, F.col("lab.b") * 1.5))
    return back.select("file_id", "name", "y", "x", *[F.col(f"rgb.{k}").alias(k.upper()) for k in "rgb"])


@query(f"WITH {WIDE_SQL}, lab AS (SELECT file_id, name, {lab_sql('r', 'g', 'b')} FROM wide), p AS (SELECT file_id, name, quantile_cont(sqrt(lab_a * lab_a + lab_b * lab_b), 0.995) AS p FROM lab GROUP BY ALL) SELECT file_id, name, CASE WHEN p < 1e-3 THEN 1 ELSE greatest(1, least(2, 114.3 / p)) END AS gain FROM p")
def auto_saturate(spark, sf):
    c = composites(spark, sf).withColumn("lab", composite.rgb_to_lab(F.col("R"), F.col("G"), F.col("B")))
    return composite.saturation_gain(c.select("file_id", "name", F.col("lab.a").alias("a"), F.col("lab.b").alias("b")), ["file_id", "name"])


@query(f"""WITH {PIXELS_SQL}, m AS (SELECT file_id, filter, avg(v) AS m FROM pixels GROUP BY ALL), g AS (SELECT *, avg(m) OVER (PARTITION BY filter) AS goal, count(*) OVER (PARTITION BY filter) AS n FROM m)
SELECT frame_id, y, x, greatest(0, least(1, v * CASE WHEN n > 1 AND m > 1e-9 THEN goal / m ELSE 1 END)) AS out FROM pixels JOIN g USING (file_id, filter)""")
def normalize_across_windows(spark, sf):
    return composite.normalise_windows(pix(spark, sf), "file_id", "filter").select("frame_id", "y", "x", "out")


@query(f"WITH {WIDE_SQL}, m AS (SELECT file_id, name, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b FROM wide GROUP BY ALL) SELECT file_id, name, greatest(0.5, least(3, g / r)) AS gain_r, greatest(0.5, least(3, g / b)) AS gain_b FROM m")
def white_balance(spark, sf):
    return composite.white_balance(composites(spark, sf), ["file_id", "name"])


@query(f"WITH {PIXELS_SQL}, t AS (SELECT frame_id, y, x, v, greatest(0, least(1, (sqrt((x - 3.5) ** 2 + (y - 3.5) ** 2) - 0.89 * 3) / 0.45)) AS t FROM pixels) SELECT frame_id, y, x, v * 0.5 * (1 + cos(t * pi())) AS v FROM t")
def limb_desaturate(spark, sf):
    return pix(spark, sf).select("frame_id", "y", "x", composite.limb_desaturate(F.col("v"), F.col("x"), F.col("y"), 3.5, 3.5, 3.0).alias("v"))


@query(f"WITH {FRAMES_SQL}, own AS (SELECT DISTINCT CAST(frame_id // 3 AS BIGINT) AS grp, filter FROM frames), spec AS (SELECT * FROM (VALUES ('RGB', 'R'), ('RGB', 'G'), ('RGB', 'B'), ('IR-RGB', 'IR'), ('IR-RGB', 'R'), ('IR-RGB', 'G'), ('IR-RGB', 'B'), ('CH4-G-IR', 'CH4'), ('CH4-G-IR', 'G'), ('CH4-G-IR', 'IR')) t(name, filter)) SELECT grp, name, list(filter ORDER BY filter) AS missing FROM (SELECT DISTINCT grp FROM own), spec WHERE (grp, filter) NOT IN (SELECT (grp, filter) FROM own) GROUP BY ALL")
def skipped_composites(spark, sf):
    return composite.skipped(frames(spark, sf).withColumn("grp", F.expr("frame_id div 3")), "grp")


@query(f'WITH {WIDE_SQL}, m AS (SELECT file_id, name, avg((r + g + b) / 3) AS m FROM wide GROUP BY ALL), goal AS (SELECT avg(m) AS goal FROM m), s AS (SELECT file_id, name, CASE WHEN m > 1e-6 THEN goal / m ELSE 1 END AS s FROM m, goal) SELECT file_id, name, y, x, greatest(0, least(1, r * s)) AS "R", greatest(0, least(1, g * s)) AS "G", greatest(0, least(1, b * s)) AS "B" FROM wide JOIN s USING (file_id, name)')
def color_luminance_match(spark, sf):
    return series.luminance_match(composites(spark, sf), ["file_id", "name"])


# -- series over frames -------------------------------------------------------------------------------------------------
@query(f"""WITH {PIXELS_SQL}, k AS (SELECT *, CASE WHEN filter IN ('R', 'G', 'B') THEN 'joint' ELSE filter END AS grp FROM pixels), s AS (SELECT *, avg(v) OVER f AS m, stddev_pop(v) OVER f AS sd, avg(v) OVER g AS gm, stddev_pop(v) OVER g AS gs FROM k WINDOW f AS (PARTITION BY frame_id), g AS (PARTITION BY grp))
SELECT frame_id, y, x, greatest(0, least(1, (v - m) / greatest(sd, 1e-7) * gs + gm)) AS out FROM s""")
def normalize_series(spark, sf):
    return series.normalise_series(pix(spark, sf)).select("frame_id", "y", "x", "out")


@query(f"WITH {PIXELS_SQL} SELECT frame_id, y, x, greatest(0, least(1, v * 0.8)) AS v FROM pixels")
def series_scale(spark, sf):
    return pix(spark, sf).select("frame_id", "y", "x", series.series_scale(F.col("v")).alias("v"))


@query(f"""WITH {SCORES_SQL}, w AS (SELECT frame_id, file_id, filter, greatest(score * score, 0.05) AS own FROM scores), c AS (SELECT *, own / sum(own) OVER (PARTITION BY file_id, filter) AS weight FROM w)
SELECT p.file_id, p.filter, p.y, p.x, CASE WHEN count(*) = 1 THEN any_value(v) ELSE greatest(0, least(1, sum(weight * v) / sum(weight))) END AS v, count(*) AS n FROM pixels p JOIN c USING (frame_id) GROUP BY ALL""")
def series_stack(spark, sf):
    w = series.series_weights(scores(spark, sf), ["file_id", "filter"], 0.3).select("frame_id", "weight")
    return stack.weighted_stack(pix(spark, sf).join(w, "frame_id"), ["file_id", "filter"], F.col("weight"))


@query(f"WITH {PIXELS_SQL}, q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, filter FROM pixels GROUP BY filter), a AS (SELECT filter, y, x, avg(greatest(0, least(1, (v - lo) / (hi - lo)))) AS v FROM pixels JOIN q USING (filter) GROUP BY ALL), m AS (SELECT filter, y, x, avg(v) AS v FROM pixels GROUP BY ALL), b AS (SELECT filter, y, x, greatest(0, least(1, (v - lo) / (hi - lo))) AS v FROM m JOIN (SELECT filter, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM m GROUP BY filter) USING (filter)) SELECT a.filter, a.y, a.x, a.v - b.v AS difference FROM a JOIN b USING (filter, y, x)")
def stretch_comparison(spark, sf):
    p = pix(spark, sf).select("filter", "y", "x", "v")
    first = composite.stretched(p, ["filter"], 0.01, 0.99, joint=True).select("filter", "y", "x", F.col("out").alias("v")).groupBy("filter", "y", "x").agg(F.avg("v").alias("a"))
    then = composite.stretched(stack.mean_stack(p, ["filter"]), ["filter"], 0.01, 0.99, joint=True).select("filter", "y", "x", F.col("out").alias("b"))
    return first.join(then, ["filter", "y", "x"]).select("filter", "y", "x", (F.col("a") - F.col("b")).alias("difference"))


# -- video files --------------------------------------------------------------------------------------------------------
VIDEO_SQL = FRAMES_SQL + """, video AS (SELECT 'f' || CAST(file_id AS VARCHAR) || '.ser' AS file, CAST(row_number() OVER (PARTITION BY file_id ORDER BY frame_id) - 1 AS INTEGER) AS frame_idx, ts,
  list_sum(list_transform(embedding, lambda v: round_even(greatest(0, least(1, (CAST(v AS DOUBLE) + 1) / 2)) * 65535, 0))) AS total FROM frames)"""


def video_files(spark: SparkSession, sf: str) -> str:
    """The folder of a shared one that the frames are written to, a video file for each file_id."""
    from lumastack.sources.ser import SerSource, write_ser

    folder = f"{shared_dir(spark)}/video/{uuid.uuid4().hex}"
    named = frames(spark, sf).withColumn("file", F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit(".ser")))
    write_ser(named, folder).count()
    spark.dataSource.register(SerSource)
    return folder


@query(f"WITH {VIDEO_SQL} SELECT file, frame_idx, ts, 8 AS h, 8 AS w, total FROM video")
def ser_round_trip(spark, sf):
    """All frames written as video files and read back."""
    from lumastack.sources.ser import frame_time

    read = spark.read.format("ser").option("path", video_files(spark, sf)).load()
    return read.select("file", "frame_idx", frame_time("ts_ticks").cast("timestamp_ntz").alias("ts"), "h", "w", F.aggregate("px", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query(f"WITH {VIDEO_SQL} SELECT file, frame_idx, ts FROM video WHERE frame_idx BETWEEN 3 AND 7 AND file IN ('f1.ser', 'f3.ser')")
def ser_frame_range(spark, sf):
    """Some frames of some files: the others are not opened or read, and no pixel is."""
    from lumastack.sources.ser import frame_time

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("ser").schema("file string, frame_idx int, ts_ticks bigint").option("pushdown", "true").option("path", video_files(spark, sf)).load()
    some = read.where(F.col("frame_idx").between(3, 7) & F.col("file").isin("f1.ser", "f3.ser"))
    return some.select("file", "frame_idx", frame_time("ts_ticks").cast("timestamp_ntz").alias("ts"))


@query(f"WITH {VIDEO_SQL} SELECT file, count(*) AS n, max(ts) AS last_ts FROM video GROUP BY file")
def stream_ser_files(spark, sf):
    """The files as a stream of frames, counted by file."""
    from lumastack.sources.ser import frame_time
    from lumastack.streaming.streams import run_to_end

    stream = spark.readStream.format("ser").schema("file string, frame_idx int, ts_ticks bigint").option("path", video_files(spark, sf)).load()
    seen = run_to_end(stream.select("file", frame_time("ts_ticks").cast("timestamp_ntz").alias("ts")), "append")
    return seen.groupBy("file").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
