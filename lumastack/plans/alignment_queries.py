"""Queries over aligned frames and patches, run logs and end-to-end jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.operators import alignment, catalog, composite, fields, kernels, sequence, series, sharpen, stack, windows
from lumastack.operators import frames as fr
from lumastack.plans import capture_queries as cq
from lumastack.plans import frame_queries as fq
from lumastack.plans.proxies import BANDS, PIXELS_SQL, SIDE, captures, frames
from lumastack.plans.register import registrar
from lumastack.sources.shared import materialise, shared_dir

QUERIES, ORACLE_SQL, query = registrar()
SIZE = 4


def references(spark, sf) -> DataFrame:
    band = stack.reference_band(fq.scores(spark, sf), "file_id", 10)
    return alignment.reference_frame(frames(spark, sf), band)


def picks(spark, sf) -> DataFrame:
    """The best tenth of each file's frames for each alignment point, weighted by their score there."""
    at_ = F.array(*[F.struct(F.lit(x).alias("ax"), F.lit(y).alias("ay")) for x, y in fq.APS])
    own = fr.ap_scores(frames(spark, sf), fq.APS, SIZE, ("frame_id", "file_id"))
    top = stack.per_ap_top(own, ["file_id", "ap_id"], 0.1)
    return top.withColumn("p", F.get(at_, F.col("ap_id"))).select("file_id", "frame_id", F.col("ap_id").cast("int").alias("ap_id"), "p.ax", "p.ay", F.pow("score", F.lit(3.0)).alias("weight"))


@query()
def reference_frame(spark, sf):
    return fq.as_pixels(references(spark, sf)).select("file_id", "y", "x", "v")


@query()
def per_ap_patch_stack(spark, sf):
    return alignment.per_ap_patch_stack(frames(spark, sf), picks(spark, sf), references(spark, sf), SIZE, rolloff=0.2)


@query()
def patch_blend_stack(spark, sf):
    base = stack.mean_stack(fq.pix(spark, sf), ["file_id"])
    return alignment.per_ap_patch_stack(frames(spark, sf), picks(spark, sf), references(spark, sf), SIZE, base=base)


@query()
def iterative_refinement(spark, sf):
    done = alignment.refine(frames(spark, sf), materialise(picks(spark, sf)), materialise(references(spark, sf)), SIZE, 2, materialise)
    return fq.as_pixels(done).select("file_id", "y", "x", "v")


@query()
def align_channels(spark, sf):
    made = alignment.as_frames(fq.channels(spark, sf), "file_id", "filter")
    return alignment.align_channels(made, "file_id")


@query()
def white_balance_disk(spark, sf):
    return alignment.disk_balance(fq.composites(spark, sf), ["file_id", "name"])


@query(f"WITH {fq.METRICS_SQL} SELECT frame_id, file_id, laplacian, tenengrad FROM metrics")
def inner_disk_score(spark, sf):
    return alignment.inner_disk_score(frames(spark, sf))


@query(f"""WITH {fq.GRADIENT_SQL}, f AS (SELECT file_id, min(frame_id) AS frame_id FROM frames GROUP BY file_id), lit AS (SELECT p.file_id, y, x FROM (SELECT *, max(v) OVER (PARTITION BY frame_id) AS top FROM pixels) p JOIN f USING (frame_id) WHERE v > 0.5 * top),
d AS (SELECT file_id, avg(x) AS cx, avg(y) AS cy, 0.64 * count(*) / pi() AS r2 FROM lit GROUP BY file_id) SELECT frame_id, g.file_id, var_pop(lap) AS laplacian, avg(g2) AS tenengrad FROM grad g JOIN d USING (file_id) WHERE (x - cx) ** 2 + (y - cy) ** 2 <= r2 GROUP BY ALL""")
def inner_disk_score_small(spark, sf):
    """The same where the disk's pixels decide: the least number of them set for frames of this size."""
    return alignment.inner_disk_score(frames(spark, sf), least=10)


@query()
def log_energy(spark, sf):
    return alignment.log_energy(frames(spark, sf), fq.APS, (2, 4, 6))


@query()
def ap_grid_adaptive(spark, sf):
    return alignment.ap_grid_adaptive(alignment.log_energy(frames(spark, sf), fq.APS, (2, 4, 6)))


@query(f"""WITH {PIXELS_SQL}, aps AS (SELECT CAST(a * 2 AS INTEGER) AS ax, CAST(b * 2 AS INTEGER) AS ay FROM range(1, 4) p(a), range(1, 4) q(b)), z AS (SELECT unnest([2, 4, 6]) AS size),
g AS (SELECT frame_id, ax, ay, size, count(*) < size * size OR avg(v) < 0.45 AS stop, stddev_pop(v) >= 0.06 AS fit FROM pixels JOIN aps ON true JOIN z ON x >= ax - size // 2 AND x < ax + size // 2 AND y >= ay - size // 2 AND y < ay + size // 2 GROUP BY frame_id, ax, ay, size),
s AS (SELECT *, bool_or(stop) OVER (PARTITION BY frame_id, ax, ay ORDER BY size) AS stopped FROM g) SELECT frame_id, ax, ay, min(size) AS size FROM s WHERE fit AND NOT stopped GROUP BY ALL""")
def ap_grid_multiscale(spark, sf):
    return alignment.ap_grid_multiscale(fq.pix(spark, sf).select("frame_id", "y", "x", "v"), (2, 4, 6), fq.APS, 0.06, 0.45)


@query(f"WITH {PIXELS_SQL}, f AS (SELECT file_id, min(frame_id) AS frame_id FROM frames GROUP BY file_id), c AS (SELECT f.file_id, sum(x * v) / sum(v) AS cx, sum(y * v) / sum(v) AS cy FROM f JOIN pixels USING (frame_id) GROUP BY ALL), aps AS (SELECT a * 2 AS ax, b * 2 AS ay FROM range(1, 4) p(a), range(1, 4) q(b)), r AS (SELECT arg_min(cx, file_id) AS cx, arg_min(cy, file_id) AS cy FROM c), s AS (SELECT file_id, CAST(ax + round_even((c.cx - r.cx) * 10, 0) AS INTEGER) AS ax, CAST(ay + round_even((c.cy - r.cy) * 10, 0) AS INTEGER) AS ay FROM c, r, aps) SELECT * FROM s WHERE ax BETWEEN 2 AND 6 AND ay BETWEEN 2 AND 6")
def session_aps(spark, sf):
    f = frames(spark, sf)
    first = f.groupBy("file_id").agg(F.min("frame_id").alias("frame_id"))
    c = fq.centers(spark, sf).join(first, ["file_id", "frame_id"]).select("file_id", "cx", "cy")
    ref = c.agg(F.min_by(F.struct("cx", "cy"), "file_id").alias("r"))
    aps = F.array(*[F.struct(F.lit(x).alias("ax"), F.lit(y).alias("ay")) for x, y in fq.APS])
    moved = c.join(F.broadcast(ref)).select("*", F.explode(aps).alias("p")).select("*", "p.*")  # ref is one row
    moved = moved.select("file_id", *[(F.col(a) + F.bround((F.col(k) - F.col(f"r.{k}")) * 10, 0)).cast("int").alias(a) for a, k in (("ax", "cx"), ("ay", "cy"))])
    return moved.where(F.col("ax").between(2, 6) & F.col("ay").between(2, 6))


@query()
def remap(spark, sf):
    made = fields.remap_frames(frames(spark, sf).select("frame_id", "h", "w", "px"), fq.points(spark, sf), 1.8, (F.col("frame_id") % 3) / 4.0, F.lit(0.0))
    return fq.as_pixels(made).select("frame_id", "y", "x", "v")


@query(fq.ORACLE_SQL["warp_field"].replace("1.8 * 1.8", "2.5 * 2.5").replace("<= 6", "<= 8").replace("conf AS c FROM", "conf * ln(1 + ax) AS c FROM"))
def warp_field_adaptive(spark, sf):
    weighed = fq.points(spark, sf).withColumn("conf", F.col("conf") * F.log1p(F.col("ax").cast("double")))
    return fields.warp_field(weighed, SIDE, SIDE, 2.5)


BELL, BEND = sharpen.blob_taps(0.75)
BLOB_SQL = " + ".join(f"{float(BELL[i] * BEND[j] + BEND[i] * BELL[j])!r} * {fq.at(i - 2, j - 2)}" for i in range(5) for j in range(5))


@query(f"WITH {fq.LIST_SQL} SELECT frame_id, y, x, {BLOB_SQL} AS v FROM grid")
def log_decompose(spark, sf):
    return fq.as_pixels(fr.with_px(frames(spark, sf), lambda a: sharpen.log_decompose(a, 2)[0])).select("frame_id", "y", "x", "v")


NEAR_SQL = [(dy, dx, f"exp(-{(dx * dx + dy * dy) / 1.125!r} - ({fq.at(dy, dx)} - v) ** 2 / 0.0128)") for dy in (-1, 0, 1) for dx in (-1, 0, 1) if abs(dx) + abs(dy) < 2]


@query(f"WITH {fq.LIST_SQL} SELECT frame_id, y, x, v - ({' + '.join(f'{w} * {fq.at(dy, dx)}' for dy, dx, w in NEAR_SQL)}) / ({' + '.join(w for _, _, w in NEAR_SQL)}) AS v FROM grid")
def bilateral_decompose(spark, sf):
    return fq.as_pixels(fr.with_px(frames(spark, sf), lambda a: sharpen.bilateral_decompose(a, 2)[0])).select("frame_id", "y", "x", "v")


#: The least radius of a disk that counts, for frames of this size.
LEAST = 1.5


@query()
def sharpen_disk_aware(spark, sf):
    return fq.as_pixels(sharpen.sharpened(frames(spark, sf), [100.0, 50.0], least=LEAST, auto=False, feather=1.0, expand=0.5, denoise=(0.1,))).select("frame_id", "y", "x", "v")


@query()
def auto_wavelet_params(spark, sf):
    return sharpen.auto_params(frames(spark, sf))


def dimmed(spark, sf) -> DataFrame:
    """Frames less half of the range, so that they have dark borders."""
    return frames(spark, sf).withColumn("px", F.transform("px", lambda v: F.greatest(v - 0.55, F.lit(0.0))))


@query(f"""WITH {PIXELS_SQL}, d AS (SELECT frame_id, y, x, greatest(v - 0.55, 0) AS v FROM pixels), p AS (SELECT frame_id, max(v) AS peak FROM d GROUP BY frame_id),
r AS (SELECT frame_id, 'r' AS side, y AS i, avg(v) AS m FROM d GROUP BY ALL UNION ALL SELECT frame_id, 'c', x, avg(v) FROM d GROUP BY ALL),
e AS (SELECT frame_id, side, coalesce(min(i) FILTER (m > 0.3 * peak), 8) AS a, coalesce(7 - max(i) FILTER (m > 0.3 * peak), 8) AS z FROM r JOIN p USING (frame_id) GROUP BY ALL),
g AS (SELECT frame_id, side, greatest(0, least(3, a - 1)) AS a, greatest(0, least(3, z - 1)) AS z FROM e)
SELECT p.frame_id, CASE WHEN peak < 1e-6 THEN 0 ELSE r.a END AS top, CASE WHEN peak < 1e-6 THEN 0 ELSE r.z END AS bottom, CASE WHEN peak < 1e-6 THEN 0 ELSE c.a END AS "left", CASE WHEN peak < 1e-6 THEN 0 ELSE c.z END AS "right" FROM p JOIN g r ON p.frame_id = r.frame_id AND r.side = 'r' JOIN g c ON p.frame_id = c.frame_id AND c.side = 'c'""")
def safe_taper_widths(spark, sf):
    """Widths of the taper that each frame has room for on its four sides."""

    def kernel(a, _):
        return dict(zip(("top", "bottom", "left", "right"), sharpen.safe_taper_widths(a, 3, 1, 0.3).astype("int32").T, strict=True))

    return fr.per_stack(dimmed(spark, sf), kernel, "top int, bottom int, left int, right int")


@query()
def preview_sharpen(spark, sf):
    """Every capture by itself: tapered where it has room, sharpened without a disk, stretched to 0.8."""
    made = fq.as_pixels(sharpen.sharpened(frames(spark, sf), [200.0, 200.0, 200.0], ("frame_id", "filter"), disk=False, taper=2, gate=0.1))
    return composite.stretched(made, ["frame_id"], 0.0, 0.99, 0.8).select("frame_id", "filter", "y", "x", F.col("out").alias("v"))


@query()
def color_sharpen(spark, sf):
    c = fq.composites(spark, sf).withColumn("lab", composite.rgb_to_lab(F.col("R"), F.col("G"), F.col("B")))
    light = alignment.as_frames(c.select("file_id", "name", "y", "x", (F.col("lab.l") / 100).alias("v")), "file_id", "name")
    sharp = fq.as_pixels(fr.with_px(light, lambda a: kernels.sharpen(a, [100.0, 50.0]), ("file_id", "name", "h", "w"))).select("file_id", "name", "y", "x", (F.col("v") * 100).alias("l"))
    joined = c.select("file_id", "name", "y", "x", F.col("lab.a").alias("a"), F.col("lab.b").alias("b")).join(sharp, ["file_id", "name", "y", "x"])
    return joined.withColumn("rgb", composite.lab_to_rgb(F.col("l"), F.col("a"), F.col("b"))).select("file_id", "name", "y", "x", "rgb.*")


def spectra(spark, sf) -> DataFrame:
    """(frame_id, filter, u, w, mag): magnitudes of each frame's spectrum."""
    import numpy as np

    made = fr.per_stack(frames(spark, sf), lambda a, _: {"m": np.abs(np.fft.fft2(a))}, "m array<double>", ("frame_id", "file_id", "filter"))
    return made.select("frame_id", "file_id", "filter", F.posexplode("m").alias("i", "mag")).select("frame_id", "file_id", "filter", F.expr(f"cast(i div {SIDE} as int)").alias("w"), (F.col("i") % SIDE).alias("u"), "mag")


@query(f"WITH {PIXELS_SQL}, {fq.DFT_SQL} SELECT filter, w, u, tanh(avg(mag) / (stddev_pop(mag) + 1e-9) / 2) AS mask FROM spec GROUP BY ALL")
def spectral_snr_mask(spark, sf):
    g = spectra(spark, sf).groupBy("filter", "w", "u").agg(F.avg("mag").alias("m"), F.stddev_pop("mag").alias("s"))
    return g.select("filter", "w", "u", F.tanh(F.col("m") / (F.col("s") + 1e-9) / 2.0).alias("mask"))


@query(f"WITH {fq.RANKED_SQL}, {fq.DFT_SQL}, fl AS (SELECT file_id, w, u, avg(mag) AS floor FROM spec WHERE frame_id IN (SELECT frame_id FROM ranked WHERE low <= floor(n * 0.25) AND frame_id NOT IN (SELECT frame_id FROM chosen)) GROUP BY ALL) SELECT frame_id, w, u, greatest(mag - floor, 0) AS signal FROM spec JOIN fl USING (file_id, w, u)")
def spectral_noise_floor(spark, sf):
    s = fq.scores(spark, sf)
    noise = stack.noise_floor_frames(s, stack.select_top(s, "file_id", 0.1, 5), "file_id").select("frame_id")
    all_ = spectra(spark, sf)
    floor = all_.join(noise, "frame_id", "left_semi").groupBy("file_id", "w", "u").agg(F.avg("mag").alias("floor"))
    return all_.join(floor, ["file_id", "w", "u"]).select("frame_id", "w", "u", F.greatest(F.col("mag") - F.col("floor"), F.lit(0.0)).alias("signal"))


# -- logs and sinks -----------------------------------------------------------------------------------------------------
@query(f"WITH {fq.CENTER_SQL.replace('WITH ', '')}, r AS (SELECT file_id, min(ts) AS ref_ts FROM frames GROUP BY file_id) SELECT frame_id, c.file_id, epoch(c.ts) - epoch(ref_ts) AS dt_sec, cx, cy, (epoch(c.ts) - epoch(ref_ts)) / (9.925 * 3600) * 360 AS delta_lambda_deg FROM centers c JOIN r USING (file_id)")
def derotation_log(spark, sf):
    ref = frames(spark, sf).groupBy("file_id").agg(F.min("ts").alias("ref_ts"))
    dt = windows.seconds(F.col("ts")) - windows.seconds(F.col("ref_ts"))
    return fq.centers(spark, sf).join(ref, "file_id").select("frame_id", "file_id", dt.alias("dt_sec"), "cx", "cy", stack.rotation_delta(dt, 9.925).alias("delta_lambda_deg"))


@query()
def composite_log(spark, sf):
    made = alignment.as_frames(fq.channels(spark, sf), "file_id", "filter")
    return alignment.align_channels(made, "file_id").groupBy("file_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("filter", F.array(F.round("dx", 2), F.round("dy", 2))))))).alias("alignment"))


@query(f"WITH {cq.CYCLES_SQL} SELECT cycle_id, filter, CAST(1 AS BIGINT) AS n_used, abs(epoch_us(ts) / 1e6 - center_s) AS avg_dt_sec FROM cycles")
def series_log(spark, sf):
    gap = F.abs(windows.seconds(F.col("ts")) - F.col("center_s"))
    return cq.cycles(spark, sf).groupBy("cycle_id", "filter").agg(F.count("*").alias("n_used"), F.avg(gap).alias("avg_dt_sec"))


@query(f"WITH {cq.SCORED_SQL} SELECT filter, stem, CAST(row_number() OVER (PARTITION BY filter ORDER BY norm_score DESC, ts, stem) AS INTEGER) AS rank FROM scored")
def ranking_sink(spark, sf):
    ranked = windows.quality_rank(windows.norm_scores(captures(spark, sf))).select("filter", "stem", "rank")
    path = f"{shared_dir(spark)}/ranking/{uuid.uuid4().hex}"
    catalog.rank_sink(ranked, path)
    return spark.read.schema("stem string, rank int, filter string").option("header", True).csv(path).select("filter", "stem", "rank")


@query(f"WITH {PIXELS_SQL} SELECT file_id, filter, frame_id FROM frames")
def step_output_reload(spark, sf):
    path = f"{shared_dir(spark)}/steps/{uuid.uuid4().hex}"
    frames(spark, sf).select("frame_id", "px", "file_id", "filter").repartition("file_id", "filter").write.partitionBy("file_id", "filter").parquet(path)
    return catalog.reload(spark, path).select("file_id", "filter", "frame_id")


SERIES_SQL = fq.SCORES_SQL + """, k AS (SELECT *, CASE WHEN filter IN ('R', 'G', 'B') THEN 'joint' ELSE filter END AS grp FROM pixels),
st AS (SELECT *, avg(v) OVER f AS m, stddev_pop(v) OVER f AS sd, avg(v) OVER g AS gm, stddev_pop(v) OVER g AS gs FROM k WINDOW f AS (PARTITION BY frame_id), g AS (PARTITION BY grp)),
nrm AS (SELECT frame_id, file_id, filter, y, x, greatest(0, least(1, (v - m) / greatest(sd, 1e-7) * gs + gm)) AS v FROM st), wt AS (SELECT frame_id, greatest(score * score, 0.05) / sum(greatest(score * score, 0.05)) OVER (PARTITION BY file_id, filter) AS weight FROM scores),
ch AS (SELECT file_id, filter, y, x, greatest(0, least(1, 0.8 * CASE WHEN count(*) = 1 THEN any_value(v) ELSE greatest(0, least(1, sum(weight * v) / sum(weight))) END)) AS v FROM nrm JOIN wt USING (frame_id) GROUP BY ALL)""" + fq.WIDE_SQL[fq.WIDE_SQL.index(", spec AS") :]


@query(f'WITH {SERIES_SQL} SELECT file_id, name, y, x, r AS "R", g AS "G", b AS "B", l AS "L" FROM wide')
def series_frames(spark, sf):
    """The series from end to end: normalised, weighted and stacked by file and filter, scaled, composed."""
    normal = series.normalise_series(fq.pix(spark, sf)).withColumn("v", F.col("out")).drop("out")
    weight = series.series_weights(fq.scores(spark, sf), ["file_id", "filter"], 0.3).select("frame_id", "weight")
    stacked = stack.weighted_stack(normal.join(weight, "frame_id"), ["file_id", "filter"], F.col("weight"))
    scaled = stacked.withColumn("v", series.series_scale(F.col("v")))
    return composite.compose_rgb(scaled, "file_id")


#: Minutes of a cycle of frames, the cycles of one stack, and the score under which a frame counts as weak.
FRAME_CYCLE, FRAME_SPAN, WEAK = 5.0, 3, 0.3
MEMBERS_SQL = fq.SCORES_SQL + f""", b AS (SELECT frame_id, filter, ts, epoch_us(ts) / 1e6 AS s, min(epoch_us(ts) / 1e6) OVER () AS t0 FROM frames), b2 AS (SELECT *, CAST(floor((s - t0) / {FRAME_CYCLE * 60}) AS BIGINT) AS cycle_id FROM b),
bins AS (SELECT *, t0 + (cycle_id + 0.5) * {FRAME_CYCLE * 60} AS center_s FROM b2 QUALIFY row_number() OVER (PARTITION BY cycle_id, filter ORDER BY abs(s - (t0 + (cycle_id + 0.5) * {FRAME_CYCLE * 60})), ts, frame_id) = 1),
one AS (SELECT DISTINCT cycle_id, center_s FROM bins), gaps AS (SELECT *, CASE WHEN center_s - lag(center_s) OVER (ORDER BY center_s) > {2 * FRAME_CYCLE * 60} THEN 1 ELSE 0 END AS gap FROM one),
isl AS (SELECT cycle_id, sum(gap) OVER (ORDER BY center_s) AS island, row_number() OVER (ORDER BY center_s) AS position FROM gaps),
mem AS (SELECT a.cycle_id, m.filter, m.frame_id, m.ts, m.s, sc.score FROM isl a JOIN isl c ON a.island = c.island AND abs(a.position - c.position) <= {FRAME_SPAN // 2} JOIN bins m ON m.cycle_id = c.cycle_id JOIN scores sc ON sc.frame_id = m.frame_id),
mid AS (SELECT cycle_id, (min(s) + max(s)) / 2 AS mid_s FROM mem GROUP BY cycle_id),
wm AS (SELECT mem.*, s - mid_s AS dt, greatest(score * score, 0.05) / sum(greatest(score * score, 0.05)) OVER (PARTITION BY cycle_id, filter) AS weight FROM mem JOIN mid USING (cycle_id))"""


def scored_frames(spark, sf) -> DataFrame:
    return frames(spark, sf).join(fq.scores(spark, sf).select("frame_id", "score"), "frame_id")


@query(f"WITH {MEMBERS_SQL} SELECT cycle_id, filter, frame_id, dt AS dt_sec, weight FROM wm")
def series_members(spark, sf):
    """The frames of each cycle's stacks, with their weights and times against its middle."""
    f = scored_frames(spark, sf).withColumnRenamed("frame_id", "stem")
    return sequence.members(f.select("stem", "ts", "filter"), FRAME_CYCLE, FRAME_SPAN, None, f, WEAK).select("cycle_id", "filter", F.col("stem").alias("frame_id"), "dt_sec", "weight")


@query(f"WITH {MEMBERS_SQL} SELECT cycle_id, filter, count(*) AS n_used, count(*) FILTER (score < {WEAK}) AS n_below, sum(weight * dt) AS avg_dt_sec FROM wm GROUP BY ALL")
def series_frame_log(spark, sf):
    f = scored_frames(spark, sf).withColumnRenamed("frame_id", "stem")
    rows = sequence.members(f.select("stem", "ts", "filter"), FRAME_CYCLE, FRAME_SPAN, None, f, WEAK)
    return rows.groupBy("cycle_id", "filter").agg(F.count("*").alias("n_used"), F.first("n_below").alias("n_below"), F.sum(F.col("weight") * F.col("dt_sec")).alias("avg_dt_sec"))


@query()
def series_frames_full(spark, sf):
    """The series from end to end: cycles, neighbourhoods, de-rotated and weighted stacks, centred, sharpened, normalised, composed, scaled."""
    made, _ = sequence.series_frames(scored_frames(spark, sf), FRAME_CYCLE, FRAME_SPAN, least=LEAST, least_score=WEAK, amounts=[100.0, 50.0])
    return made


@query()
def series_frames_single(spark, sf):
    """The same of single cycles, whose channels are aligned."""
    made, _ = sequence.series_frames(scored_frames(spark, sf), FRAME_CYCLE, 1, least=LEAST, least_score=WEAK)
    return made


@query()
def master_sharpen(spark, sf):
    """The stack of every file and filter, tapered and sharpened about its own disk; a filter that a file lacks has one row without values."""
    stacked = stack.weighted_stack(fq.scored_pixels(spark, sf), ["file_id", "filter"], F.col("score"))
    made = sharpen.sharpened(alignment.as_frames(stacked, "file_id", "filter"), [100.0, 50.0], ("file_id", "filter"), taper=2, least=LEAST, denoise=(0.1, 0.1))
    wanted = frames(spark, sf).select("file_id").distinct().select("file_id", F.explode(F.array(*[F.lit(b) for b in BANDS])).alias("filter"))
    return wanted.join(fq.as_pixels(made).select("file_id", "filter", "y", "x", "v"), ["file_id", "filter"], "left")
