"""Jobs that align frames or patches to references, and stacks built from aligned patches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumastack.operators import kernels
from lumastack.operators.fields import patch_stack
from lumastack.operators.frames import ellipses, per_stack, with_px
from lumastack.operators.stack import clip01, covered


def pixel_table(frames: DataFrame, *keep: str) -> DataFrame:
    """One row per pixel: kept columns, y, x, v."""
    return frames.select(*keep, "w", F.posexplode("px").alias("_i", "v")).select(*keep, F.expr("cast(_i div w as int)").alias("y"), (F.col("_i") % F.col("w")).alias("x"), "v")


def as_frames(pixels: DataFrame, *by: str) -> DataFrame:
    """Pixel rows gathered into frames again: by, h, w, px."""
    g = pixels.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("_p"))
    return g.select(*by, F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("_p.v").alias("px"))


def reference_frame(frames: DataFrame, band: DataFrame, by: str = "file_id", most: float = 20.0) -> DataFrame:
    """(by, h, w, px): the mean of each file's band of frames after alignment to its first one; frames off by more than `most` go in as they are.

    The first frame of a file is joined to its others, so files are aligned side by side, each frame on its own.
    """
    held = frames.join(band.select("frame_id"), "frame_id", "left_semi")
    first = held.groupBy(by).agg(F.min_by("px", "frame_id").alias("ref"))

    def kernel(a, rows):
        refs = rows.column("ref").flatten().to_numpy(zero_copy_only=False).reshape(a.shape)
        moved = []
        for f, r in zip(a, refs, strict=True):
            dx, dy, _ = kernels.phase_shift(r, f[None])[0]
            moved.append(f if max(abs(dx), abs(dy)) > most else kernels.shift(f, -dx, -dy))
        return {"px": np.stack(moved)}

    moved = per_stack(held.join(first, by), kernel, "px array<double>", ("frame_id", by, "h", "w", "ref")).drop("ref")
    mean = pixel_table(moved, "frame_id", by).groupBy(by, "y", "x").agg(clip01(F.avg("v")).alias("v"))
    return as_frames(mean, by)


def align_channels(channels: DataFrame, by: str, order: tuple[str, ...] = ("L", "IR", "R", "G", "B", "CH4"), most: float = 20.0) -> DataFrame:
    """(by, filter, dx, dy, reference): each channel's displacement against the group's reference channel, the first present in order; 0 where it is over `most`."""
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("filter"))
    ref = channels.where(place > 0).groupBy(by).agg(F.min_by(F.struct(F.col("px").alias("ref"), F.col("filter").alias("reference")), place).alias("_r")).select(by, "_r.ref", "_r.reference")

    def kernel(a, rows):
        refs = rows.column("ref").flatten().to_numpy(zero_copy_only=False).reshape(a.shape)
        s = np.concatenate([kernels.phase_shift(r, f[None]) for f, r in zip(a, refs, strict=True)])[:, :2]
        s = np.where(np.abs(s).max(1, keepdims=True) > most, 0.0, s)
        same = np.array([f == r for f, r in zip(rows.column("filter").to_pylist(), rows.column("reference").to_pylist(), strict=True)])
        s[same] = 0.0
        return {"dx": s[:, 0], "dy": s[:, 1]}

    return per_stack(channels.join(ref, by), kernel, "dx double, dy double", (by, "filter", "reference", "ref")).drop("ref")


def disk_balance(composites: DataFrame, by: list[str], most: float = 20.0) -> DataFrame:
    """(by, gain_r, gain_b, dx_r, dy_r, dx_b, dy_b): medians of green over red and over blue on green's disk, in 0.5..3, and by how
    much red and blue are displaced against green, within `most`; shifts on the disk's box if it is large, else on the frame."""
    p = composites.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.array_sort(F.collect_list(F.struct("y", "x", "R", "G", "B"))).alias("_p"))
    rows = p.select(*by, "h", "w", F.col("_p.G").alias("px"), F.col("_p.R").alias("_r"), F.col("_p.B").alias("_b"))

    def one(g, cx, cy, radius, others):
        h, w = g.shape
        y, x = np.ogrid[:h, :w]
        mask = (x - cx) ** 2 + (y - cy) ** 2 <= radius**2
        box = np.s_[int(max(0, cy - radius)) : int(min(h, cy + radius)), int(max(0, cx - radius)) : int(min(w, cx + radius))] if mask.sum() > 100 and radius >= 10 else np.s_[:, :]
        mask = mask if mask.any() else np.ones_like(mask)
        middles = [float(np.median(c[mask])) for c in others]
        gains = [float(np.clip(np.median(g[mask]) / m, 0.5, 3.0)) if m > 1e-6 else 1.0 for m in middles]
        shifts = [np.clip(kernels.phase_shift(g[box], c[box][None])[0, :2], -most, most) for c in others]
        return [*gains, *shifts[0], *shifts[1]]

    def kernel(a, table):
        others = [table.column(c).flatten().to_numpy(zero_copy_only=False).reshape(a.shape) for c in ("_r", "_b")]
        e = ellipses(a)
        found = np.array([one(*x, (r, b)) for *x, r, b in zip(a, e["cx"], e["cy"], e["semi_major"], *others, strict=True)])
        return dict(zip(("gain_r", "gain_b", "dx_r", "dy_r", "dx_b", "dy_b"), found.T, strict=True))

    return per_stack(rows, kernel, "gain_r double, gain_b double, dx_r double, dy_r double, dx_b double, dy_b double", (*by, "_r", "_b")).drop("_r", "_b")


def per_ap_patch_stack(frames: DataFrame, picks: DataFrame, references: DataFrame, size: int, by: str = "file_id", base: DataFrame | None = None, rolloff: float = 0.0) -> DataFrame:
    """(by, y, x, v): fields.patch_stack as a row for each pixel of the stacks; base likewise (by, y, x, v)."""
    return pixel_table(patch_stack(frames, picks, references, size, by, None if base is None else as_frames(base, by), rolloff), by)


def refine(frames: DataFrame, picks: DataFrame, references: DataFrame, size: int, rounds: int, store) -> DataFrame:
    """The patch stack taken as reference again, `rounds` times (a small fixed number); store() writes each round's frames and reads them again."""
    for _ in range(rounds):
        references = store(patch_stack(frames, picks, references, size))
    return references


def inner_disk_score(frames: DataFrame, part: float = 0.8, by: str = "file_id", least: int = 100) -> DataFrame:
    """Variance of the Laplacian and mean squared gradient within `part` of the radius of the disk of each file's first frame; of the whole frame if that has under `least` pixels."""
    first = frames.groupBy(by).agg(F.min_by("px", "frame_id").alias("ref"))

    def kernel(a, rows):
        refs = rows.column("ref").flatten().to_numpy(zero_copy_only=False).reshape(a.shape)
        lap, ten = kernels.laplacian(a), kernels.gradient2(a)
        y, x = np.mgrid[: a.shape[1], : a.shape[2]]
        out = []
        for i, r in enumerate(refs):
            lit = r > 0.5 * r.max()
            cy, cx = (float(q[lit].mean()) for q in (y, x))
            mask = (y - cy) ** 2 + (x - cx) ** 2 <= part**2 * lit.sum() / np.pi
            mask = mask if mask.sum() >= least else np.ones_like(mask)
            out.append((lap[i][mask].var(), ten[i][mask].mean()))
        return {"laplacian": np.array([o[0] for o in out]), "tenengrad": np.array([o[1] for o in out])}

    return per_stack(frames.join(first, by), kernel, "laplacian double, tenengrad double", ("frame_id", by, "ref")).drop("ref")


def log_energy(frames: DataFrame, points: list[tuple[int, int]], sizes: tuple[int, ...]) -> DataFrame:
    """(frame_id, ax, ay, size, energy): the squared blob response of each scale in the middle of each patch, times the scale squared."""

    def kernel(a, _):
        out = [[] for _ in a]
        for size in sizes:
            sigma = size / 4
            response = kernels.laplacian(kernels.separable(a, kernels.gauss_taps(sigma))) ** 2
            for x, y in points:
                half = max(1, size // 2)
                e = sigma**2 * response[:, max(0, y - half) : y + half, max(0, x - half) : x + half].mean((1, 2))
                for i, v in enumerate(e.tolist()):
                    out[i].append({"ax": x, "ay": y, "size": size, "energy": v})
        return {"e": out}

    made = per_stack(frames, kernel, "e array<struct<ax:int,ay:int,size:int,energy:double>>")
    return made.select("frame_id", F.explode("e").alias("e")).select("frame_id", "e.*")


def ap_grid_adaptive(energies: DataFrame) -> DataFrame:
    """Each point's size of largest energy; then points greedily by energy, none within half the size of a stronger one.

    The greedy step is a group for each frame, of as many rows as the frame has grid points.
    """
    best = energies.groupBy("frame_id", "ax", "ay").agg(F.max_by(F.struct("size", "energy"), "energy").alias("b")).select("frame_id", "ax", "ay", "b.size", "b.energy")

    def greedy(pdf):
        kept = []
        for i, r in enumerate(pdf.sort_values(["energy", "ay", "ax"], ascending=[False, True, True]).itertuples(index=False)):
            if all((r.ax - k.ax) ** 2 + (r.ay - k.ay) ** 2 > (k.size / 2) ** 2 for k in kept):
                kept.append(r)
        return type(pdf)(kept, columns=pdf.columns)

    return best.groupBy("frame_id").applyInPandas(greedy, best.schema)


def ap_grid_multiscale(patches: DataFrame, sizes: tuple[int, ...], points: list[tuple[int, int]], contrast: float, dark: float) -> DataFrame:
    """(frame_id, ax, ay, size): the smallest size at each point with enough contrast, unless a smaller one is dark or reaches over the border."""
    spark = patches.sparkSession
    cover = covered(spark.createDataFrame([(x, y, s) for x, y in points for s in sizes], "ax int, ay int, size int"))
    g = patches.join(cover, ["y", "x"]).groupBy("frame_id", "ax", "ay", "size").agg(F.count("*").alias("n"), F.stddev_pop("v").alias("s"), F.avg("v").alias("m"))
    g = g.withColumn("stop", (F.col("n") < F.col("size") * F.col("size")) | (F.col("m") < dark)).withColumn("fit", F.col("s") >= contrast)
    stopped = F.max(F.col("stop").cast("int")).over(Window.partitionBy("frame_id", "ax", "ay").orderBy("size"))
    return g.withColumn("stopped", stopped).where("fit AND stopped = 0").groupBy("frame_id", "ax", "ay").agg(F.min("size").alias("size"))
