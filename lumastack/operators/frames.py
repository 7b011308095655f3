"""Jobs over frames: kernels applied batch by batch, and array expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumastack.operators import contours, kernels
from lumastack.operators.contours import ellipses
from lumastack.sources.shared import materialise

#: Pixels that one kernel call takes at most.
STACK = 250_000


def column(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    """Values of n frames as an Arrow column; arrays of more dimensions become lists."""
    if isinstance(values, np.ndarray) and values.ndim > 1:
        values = list(values.reshape(len(values), -1))
    return pa.array(values, kind)


def per_stack(frames: DataFrame, kernel: Callable[[np.ndarray, pa.RecordBatch], dict], schema: str, keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """kernel(stack (n, h, w), rows) -> {column: n values} over frames; the kept columns and the kernel's.

    A narrow job: frames of one shape in an Arrow batch go through the kernel together, STACK pixels at a time. Frames
    whose px is null or does not have h times w values are left out.
    """
    fields = T._parse_datatype_string(schema).fields
    rows = frames.where((F.size("px") == F.col("h") * F.col("w")) & (F.col("h") > 0)).select(*keep, *(c for c in ("h", "w") if c not in keep), F.col("px").cast("array<double>").alias("px"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            shape = np.stack((batch.column("h").to_numpy(), batch.column("w").to_numpy()), 1)
            for h, w in np.unique(shape, axis=0).tolist():
                at = np.flatnonzero((shape == (h, w)).all(1))
                for i in range(0, len(at), max(1, STACK // (h * w))):
                    part = batch.take(pa.array(at[i : i + max(1, STACK // (h * w))]))
                    stack = part.column("px").flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w)
                    made = kernel(stack, part)
                    arrays = [column(made[f.name], t) for f, t in zip(fields, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *arrays], names=[*keep, *(f.name for f in fields)])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keep), *fields]))


def with_px(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], keep: tuple[str, ...] = ("frame_id", "h", "w")) -> DataFrame:
    """Frames with px replaced by the kernel's result."""
    own = tuple(k for k in keep if k not in ("h", "w"))
    made = per_stack(frames, lambda a, _: {"h": np.full(len(a), a.shape[1], np.int32), "w": np.full(len(a), a.shape[2], np.int32), "px": kernel(a)}, "h int, w int, px array<double>", own)
    return made


def range_normalised(px: Column) -> Column:
    """Pixels in 0..1: those over 1 are 8- or 16-bit values."""
    top = F.array_max(px)
    return F.when(top > 255, F.transform(px, lambda v: v / 65535.0)).when(top > 1, F.transform(px, lambda v: v / 255.0)).otherwise(px)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """BT.709 luminance."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def crop_center(frames: DataFrame, size: int, cx: Column, cy: Column, bayer: bool = False) -> DataFrame:
    """Square crops around (cx, cy), rounded half to even; zeros outside the frame. With a colour mosaic the centre is rounded to
    even pixels and the size down to an even one."""
    if bayer:
        size, cx, cy = size // 2 * 2, 2 * F.bround(cx / 2, 0), 2 * F.bround(cy / 2, 0)
    left = (F.bround(cx, 0) - size // 2).cast("int")
    top = (F.bround(cy, 0) - size // 2).cast("int")
    placed = frames.withColumn("_l", left).withColumn("_t", top)

    def fetch(i: Column) -> Column:
        x, y = F.col("_l") + i % size, F.col("_t") + F.floor(i / size).cast("int")
        inside = (x >= 0) & (y >= 0) & (x < F.col("w")) & (y < F.col("h"))
        return F.when(inside, F.try_element_at("px", (y * F.col("w") + x + 1).cast("int"))).otherwise(0.0)

    out = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), fetch)
    return placed.withColumn("px", out).withColumn("h", F.lit(size)).withColumn("w", F.lit(size)).drop("_l", "_t")


def quality_metrics(frames: DataFrame, keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Whole-frame metrics: variance of the Laplacian, mean squared gradient, variance over mean."""

    def kernel(a, _):
        lap, ten, mean = kernels.laplacian(a).var((1, 2)), kernels.gradient2(a).mean((1, 2)), a.mean((1, 2))
        return {"laplacian": lap, "tenengrad": ten, "norm_variance": np.where(mean > 1e-9, a.var((1, 2)) / np.where(mean > 1e-9, mean, 1), 0)}

    return per_stack(frames, kernel, "laplacian double, tenengrad double, norm_variance double", keep)


def frame_quality(frames: DataFrame, margin: float = 0.15) -> DataFrame:
    """Metrics in the planet's mask: the largest part over the Otsu threshold less a margin (the whole frame without one);
    Laplacian and gradient on the frame blurred by 1.2."""

    def kernel(a, _):
        blurred = kernels.separable(a, kernels.gauss_taps(1.2))
        lap, ten = kernels.laplacian(blurred), kernels.gradient2(blurred)
        bytes_ = kernels.gray8(a)
        out = {"laplacian": [], "tenengrad": [], "norm_variance": []}
        for i, t in enumerate(kernels.otsu(bytes_)):
            mask = kernels.largest_component(bytes_[i] > t * (1 - margin))
            mask = np.ones(a[i].shape, bool) if mask is None else mask
            mean = a[i][mask].mean()
            for k, v in (("laplacian", lap[i][mask].var()), ("tenengrad", ten[i][mask].mean()), ("norm_variance", a[i][mask].var() / mean if mean > 1e-9 else 0.0)):
                out[k].append(v)
        return {k: np.array(v) for k, v in out.items()}

    return per_stack(frames, kernel, "laplacian double, tenengrad double, norm_variance double")


def log_disk_score(frames: DataFrame, sigma: float = 3.0, level: float = 0.25, least: int = 50) -> DataFrame:
    """Variance of the Laplacian of the blurred frame over its bright part; 0 with fewer than `least` bright pixels."""

    def kernel(a, _):
        a = a / np.maximum(a.max((1, 2), keepdims=True), 1e-12)
        mask = a > level
        n = mask.sum((1, 2))
        lap = kernels.laplacian(kernels.separable(a, kernels.gauss_taps(sigma)))
        mean = (lap * mask).sum((1, 2)) / np.maximum(n, 1)
        return {"score": np.where(n >= least, (((lap - mean[:, None, None]) ** 2) * mask).sum((1, 2)) / np.maximum(n, 1), 0.0)}

    return per_stack(frames, kernel, "score double")


def local_gradient_score(frames: DataFrame, aps: list[tuple[int, int]], size: int) -> DataFrame:
    """The mean over alignment points of the largest squared gradient in the patch around each."""
    half = size // 2

    def kernel(a, _):
        g = kernels.gradient2(a)
        return {"score": np.mean([g[:, max(0, y - half) : y + half, max(0, x - half) : x + half].max((1, 2)) for x, y in aps], axis=0)}

    return per_stack(frames, kernel, "score double")


def ap_scores(frames: DataFrame, aps: list[tuple[int, int]], size: int, keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """(kept columns, ap_id, score): the largest squared gradient of each patch."""
    half = size // 2

    def kernel(a, _):
        g = kernels.gradient2(a)
        return {"scores": np.stack([g[:, max(0, y - half) : y + half, max(0, x - half) : x + half].max((1, 2)) for x, y in aps], 1)}

    return per_stack(frames, kernel, "scores array<double>", keep).select(*keep, F.posexplode("scores").alias("ap_id", "score"))


def log_ap_scores(frames: DataFrame, aps: list[tuple[int, int]], size: int, sigma: float = 3.0, level: float = 0.25, keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """(kept columns, ap_id, score): the variance of the Laplacian of each blurred patch over its bright pixels (against its peak); 0 with
    fewer than five of them. Patches must lie inside the frame."""
    half = size // 2

    def kernel(a, _):
        out = []
        for x, y in aps:
            p = a[:, y - half : y + half, x - half : x + half]
            p = p / np.where((top := p.max((1, 2), keepdims=True)) > 1e-9, top, 1.0)
            mask, lap = p > level, kernels.laplacian(kernels.separable(p, kernels.gauss_taps(sigma)))
            n = np.maximum(mask.sum((1, 2)), 1)
            mean = (lap * mask).sum((1, 2)) / n
            out.append(np.where(mask.sum((1, 2)) >= 5, ((lap - mean[:, None, None]) ** 2 * mask).sum((1, 2)) / n, 0.0))
        return {"scores": np.stack(out, 1)}

    if any(x < half or y < half for x, y in aps):
        raise ValueError("alignment points must lie at least half a patch inside the frame")
    return per_stack(frames, kernel, "scores array<double>", keep).select(*keep, F.posexplode("scores").alias("ap_id", "score"))


def patch_sharpness(frames: DataFrame, aps: list[tuple[int, int]], size: int, keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """(kept columns, ap_id, sharpness): the variance of the Laplacian of each patch, mirrored at the patch's own border."""
    half = size // 2

    def kernel(a, _):
        return {"s": np.stack([kernels.laplacian(a[:, y - half : y + half, x - half : x + half]).var((1, 2)) for x, y in aps], 1)}

    return per_stack(frames, kernel, "s array<double>", keep).select(*keep, F.posexplode("s").alias("ap_id", "sharpness"))


def thresholds(frames: DataFrame) -> DataFrame:
    """Otsu and triangle thresholds (0..255) of each frame stretched to bytes."""

    def kernel(a, _):
        g = kernels.gray8(a)
        return {"otsu": kernels.otsu(g).astype(np.int32), "triangle": kernels.triangle(g).astype(np.int32)}

    return per_stack(frames, kernel, "otsu int, triangle int")


def components(frames: DataFrame, most: float = 0.9) -> DataFrame:
    """The largest bright part of each frame: x, y, width, height, area and the lit part of its four edges; null if there is none or it covers over `most`."""

    def kernel(a, _):
        g = kernels.gray8(kernels.separable(a, kernels.B3))
        rows = []
        for image, t in zip(g, kernels.triangle(g), strict=True):
            part = kernels.largest_component(image > t)
            if part is None or part.mean() > most:
                rows.append((None,) * 6)
                continue
            ys, xs = np.flatnonzero(part.any(1)), np.flatnonzero(part.any(0))
            roi = part[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
            rows.append((int(xs[0]), int(ys[0]), len(roi[0]), len(roi), int(part.sum()), float(max(roi[0].mean(), roi[-1].mean(), roi[:, 0].mean(), roi[:, -1].mean()))))
        return {k: [r[i] for r in rows] for i, k in enumerate(("bx", "by", "bw", "bh", "area", "edge"))}

    return per_stack(frames, kernel, "bx int, by int, bw int, bh int, area int, edge double", ("frame_id", "h", "w"))


def screen_shape(boxes: DataFrame, padding: int = 1, aspect: float = 0.3, edge: float = 0.9, least: int = 3) -> DataFrame:
    """Adds reject (the first reason, or null) and the box's centre."""
    reason = (
        F.when(F.col("bx").isNull(), "none")
        .when((F.col("bx") < padding) | (F.col("by") < padding) | (F.col("bx") + F.col("bw") > F.col("w") - padding) | (F.col("by") + F.col("bh") > F.col("h") - padding), "border")
        .when(F.least("bw", "bh") / F.greatest("bw", "bh") < 1 - aspect, "aspect")
        .when(F.col("edge") > edge, "edge")
        .when(F.greatest("bw", "bh") < least, "small")
    )
    return boxes.withColumn("reject", reason).withColumn("cx", F.col("bx") + F.col("bw") / 2).withColumn("cy", F.col("by") + F.col("bh") / 2)


def lit_boxes(frames: DataFrame, level: float, keep: tuple[str, ...] = ("frame_id", "file_id")) -> DataFrame:
    """The box of the pixels over a level: bx, by, bw, bh and the largest lit part of its four edges; frames without any are left out."""

    def kernel(a, _):
        rows = []
        for lit in a > level:
            if not lit.any():
                rows.append((None,) * 5)
                continue
            ys, xs = np.flatnonzero(lit.any(1)), np.flatnonzero(lit.any(0))
            roi = lit[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
            rows.append((int(xs[0]), int(ys[0]), roi.shape[1], roi.shape[0], float(max(roi[0].mean(), roi[-1].mean(), roi[:, 0].mean(), roi[:, -1].mean()))))
        return {k: [r[i] for r in rows] for i, k in enumerate(("bx", "by", "bw", "bh", "edge"))}

    return per_stack(frames, kernel, "bx int, by int, bw int, bh int, edge double", (*keep, "h", "w")).where("bx IS NOT NULL")


@dataclass
class SizeGate:
    """The sizes accepted last, and whether a frame is: once `start` frames are accepted, one smaller than the median of the last
    `window` accepted ones by more than the tolerance is rejected, and does not count."""

    window: int = 100
    tolerance: float = 0.05
    start: int = 20
    ws: list = field(default_factory=list)
    hs: list = field(default_factory=list)

    def accepts(self, w: float, h: float) -> bool:
        if len(self.ws) >= self.start and (w < np.median(self.ws) * (1 - self.tolerance) or h < np.median(self.hs) * (1 - self.tolerance)):
            return False
        self.ws, self.hs = [*self.ws, float(w)][-self.window :], [*self.hs, float(h)][-self.window :]
        return True


def size_gate(boxes: DataFrame, window: int = 100, tolerance: float = 0.05, start: int = 20) -> DataFrame:
    """(file_id, frame_idx, accepted) by SizeGate, each file in order of frame_idx.

    The rule feeds back, so a file is taken in order by one task; only sizes are sent, sorted by Spark, and only the last
    `window` accepted ones are held.
    """

    def gate(parts):
        key, own = object(), None
        for pdf in parts:
            flags = []
            for file, w, h in zip(pdf["file_id"], pdf["bw"], pdf["bh"], strict=True):
                if own is None or file != key and not (file != file and key != key):  # null is one file
                    key, own = file, SizeGate(window, tolerance, start)
                flags.append(own.accepts(w, h))
            yield pdf[["file_id", "frame_idx"]].assign(accepted=flags)

    sizes = boxes.select("file_id", "frame_idx", "bw", "bh")
    ordered = sizes.repartition("file_id").sortWithinPartitions("file_id", F.asc_nulls_last("frame_idx"), "bw", "bh")
    return ordered.mapInPandas(gate, T.StructType([sizes.schema["file_id"], sizes.schema["frame_idx"], T.StructField("accepted", T.BooleanType())]))


def screen_stats(screened: DataFrame, by: str = "file_id") -> DataFrame:
    """Frames, accepted and rejected by reason, and the rate, for each file and in all (null)."""
    good = F.count(F.when(F.col("reject").isNull(), 1))
    n = F.count("*")
    small = F.count(F.when(F.col("reject") == "size", 1))
    return screened.rollup(by).agg(n.alias("total"), good.alias("accepted"), (n - good - small).alias("rejected_detect"), small.alias("rejected_size"), F.when(n > 0, good / n).otherwise(0.0).alias("rate"))


def disk_moments(frames: DataFrame, threshold: int = 127) -> DataFrame:
    """The centre of gravity of the pixels over a threshold (of 255); null without any."""

    def kernel(a, _):
        lit = np.floor(np.clip(a, 0, 1) * 255) > threshold
        n = lit.sum((1, 2))
        y, x = np.mgrid[: a.shape[1], : a.shape[2]]
        safe = np.maximum(n, 1)
        return {"n": n.astype(np.int64), "cx": np.where(n, (lit * x).sum((1, 2)) / safe, np.nan), "cy": np.where(n, (lit * y).sum((1, 2)) / safe, np.nan)}

    return per_stack(frames, kernel, "n bigint, cx double, cy double").withColumn("cx", F.when(F.col("n") > 0, F.col("cx"))).withColumn("cy", F.when(F.col("n") > 0, F.col("cy")))


def disk_ellipse(frames: DataFrame, margin: float = 0.1, fixed: int = 0) -> DataFrame:
    """Centre, half axes and angle of the bright disk from the ellipse through its outline (contours.ellipses); quarter-frame circle where nothing is found."""
    return per_stack(frames, lambda a, _: ellipses(a, margin, fixed), "cx double, cy double, semi_major double, semi_minor double, angle double")


def closed_disks(frames: DataFrame, margin: float = 0.1, fixed: int = 0) -> DataFrame:
    """(frame_id, n_lit, n_closed, closed): pixels of the disk's mask before and after closing, and the closed mask row by row as text of 0 and 1."""

    def kernel(a, _):
        before = contours.lit(a, margin, fixed)
        after = contours.close(before)
        return {"n_lit": before.sum((1, 2)), "n_closed": after.sum((1, 2)), "closed": ["".join(map(str, m.ravel().astype(int))) for m in after]}

    return per_stack(frames, kernel, "n_lit bigint, n_closed bigint, closed string")


def shifts_to(frames: DataFrame, reference: list[list[float]], method: str = "phase", confidence: float = 0.0, most: float = 20.0) -> DataFrame:
    """(frame_id, dx, dy, conf, ok): by how much each frame is displaced against the reference frame, and whether that is trusted:
    enough confidence, and neither component over `most`. Method `phase` or `ncc`.

    The reference is one frame, sent with the job.
    """
    ref = np.array(reference)
    find = {"phase": kernels.phase_shift, "ncc": kernels.ncc_shift}[method]

    def kernel(a, _):
        s = find(ref, a)
        return {"dx": s[:, 0], "dy": s[:, 1], "conf": s[:, 2]}

    found = per_stack(frames, kernel, "dx double, dy double, conf double")
    return found.withColumn("ok", (F.col("conf") >= confidence) & (F.greatest(F.abs("dx"), F.abs("dy")) <= most))


def phase_qsf_shifts(frames: DataFrame, reference: list[list[float]], confidence: float = 0.15, most: float = 20.0) -> DataFrame:
    """(frame_id, dx, dy, conf): phase correlation gated by its confidence, refined between pixels by a quadratic; rejected shifts are null with confidence 0.

    The sign is that of the other shifts: the displacement of the frame.
    """
    found = shifts_to(frames, reference, "phase", confidence, most)
    ok = F.col("ok")
    return found.select("frame_id", F.when(ok, F.col("dx")).alias("dx"), F.when(ok, F.col("dy")).alias("dy"), F.when(ok, F.col("conf")).otherwise(0.0).alias("conf"))


def shift_frames(frames: DataFrame, border: str = "edge") -> DataFrame:
    """Frames (with columns dx, dy) moved back by their displacement."""

    def kernel(a, rows):
        return {"h": np.full(len(a), a.shape[1], np.int32), "w": np.full(len(a), a.shape[2], np.int32), "px": np.stack([kernels.shift(f, -dx, -dy, border) for f, dx, dy in zip(a, rows.column("dx").to_pylist(), rows.column("dy").to_pylist(), strict=True)])}

    keep = tuple(c for c in frames.columns if c not in ("h", "w", "px"))
    return per_stack(frames, kernel, "h int, w int, px array<double>", keep).drop("dx", "dy")


#: Frequencies that one row of partial spectra has at most.
FREQUENCIES = 16_384


def spectra_floor(frames: DataFrame, by: str) -> DataFrame:
    """(by, h, w, floor): the mean magnitude by frequency of the frames given (those of the noise floor), one row a group."""
    sums = spectral_sums(frames.withColumn("_q", F.lit(1.0)), by, 1.0, None)
    mean = sums.select(by, "h", "w", "block", F.transform("mag", lambda m: m / F.col("n")).alias("m"))
    return mean.groupBy(by, "h", "w").agg(F.flatten(F.array_sort(F.collect_list(F.struct("block", "m")))["m"]).alias("floor"))


def spectral_sums(frames: DataFrame, by: str, power: float, floors: DataFrame | None) -> DataFrame:
    """(by, h, w, block, n, re, im, wt, mag, mag2): sums over each group's frames of weighted spectra, weights, magnitudes and their squares.

    Tasks add up their own frames (64 groups at a time) and send blocks of FREQUENCIES; a group costs a row for each task
    and block, added up block by block.
    """
    rows = frames.select(by, "h", "w", F.col("px").cast("array<double>").alias("px"), F.col("_q").cast("double").alias("_q")).where((F.size("px") == F.col("h") * F.col("w")) & (F.col("h") > 0))
    rows = rows.join(floors, [by, "h", "w"], "left") if floors is not None else rows.withColumn("floor", F.lit(None).cast("array<double>"))
    names = ("re", "im", "wt", "mag", "mag2")
    schema = T.StructType([rows.schema[by], *T._parse_datatype_string("h int, w int, block int, n bigint, " + ", ".join(f"{k} array<double>" for k in names)).fields])

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        for (key, h, w), (n, sums) in held.items():
            starts = range(0, h * w, FREQUENCIES)
            data = {by: [key] * len(starts), "h": [h] * len(starts), "w": [w] * len(starts), "block": list(range(len(starts))), "n": [n] * len(starts)}
            data |= {k: [s[i : i + FREQUENCIES] for i in starts] for k, s in zip(names, sums, strict=True)}
            yield pa.RecordBatch.from_pydict(data, schema=to_arrow_schema(schema))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in (by, "h", "w")), strict=True)):
                f = np.fft.fft2(batch.column("px")[i].values.to_numpy(zero_copy_only=False).reshape(key[1:])).ravel()
                mag = np.abs(f)
                floor = batch.column("floor")[i]
                left = np.maximum(mag - floor.values.to_numpy(zero_copy_only=False), 0) if floor.is_valid else mag
                wt = max(batch.column("_q")[i].as_py(), 1e-9) * left**power
                if key not in held and len(held) >= 64:
                    yield from told(held)
                    held = {}
                n, sums = held.get(key, (0, 0))
                held[key] = (n + 1, sums + np.stack((wt * f.real, wt * f.imag, wt, mag, mag * mag)))
        yield from told(held)

    def add(pdf):
        first = pdf.iloc[:1].copy()
        first["n"] = pdf["n"].sum()
        for k in names:
            first[k] = [np.sum(np.stack(pdf[k].to_numpy()), 0)]
        return first

    return rows.mapInArrow(partial, schema).groupBy(by, "h", "w", "block").applyInPandas(add, schema)


def fourier_stack(frames: DataFrame, by: str = "filter", power: float = 1.0, weight: Column | None = None, floors: DataFrame | None = None, snr: float = 0.0, rolloff: float = 0.0) -> DataFrame:
    """(by, h, w, px): frames of each group combined by frequency: the mean of spectra weighted by magnitude to a power, then one inverse transform.

    weight: a factor for each frame (a score to a power). floors (by, h, w, floor): magnitudes taken off before weighting.
    snr: if over 0, frequencies are masked by tanh of their mean magnitude over its deviation and over snr. rolloff: if over
    0, the deviation of a Gaussian over frequencies. Frames whose px does not fit are left out.
    """
    sums = spectral_sums(frames.withColumn("_q", F.lit(1.0) if weight is None else weight), by, power, floors)
    each = F.arrays_zip("re", "im", "wt", "mag", "mag2")

    def masked(part: str):
        def value(s):
            mean, mean2 = s["mag"] / F.col("n"), s["mag2"] / F.col("n")
            mask = F.tanh(mean / (F.sqrt(F.greatest(F.lit(0.0), mean2 - mean * mean)) + 1e-9) / snr) if snr else F.lit(1.0)
            return F.when(s["wt"] > 1e-12, s[part] / s["wt"] * mask).otherwise(0.0)

        return F.transform(each, value)

    blocks = sums.select(by, "h", "w", F.struct("block", masked("re").alias("re"), masked("im").alias("im")).alias("b"))
    whole = blocks.groupBy(by, "h", "w").agg(F.array_sort(F.collect_list("b")).alias("b")).select(by, "h", "w", F.flatten("b.re").alias("px"), F.flatten("b.im").alias("im"))

    def back(a, rows):
        f = a + 1j * rows.column("im").flatten().to_numpy(zero_copy_only=False).reshape(a.shape)
        f = f * kernels.rolloff(*a.shape[1:], rolloff) if rolloff else f
        return {"px": np.clip(np.real(np.fft.ifft2(f)), 0, 1)}

    return per_stack(whole, back, "px array<double>", (by, "h", "w", "im")).select(by, "h", "w", "px")


def poisson_grid(frames: DataFrame, size: int, part: float) -> DataFrame:
    """Alignment points of each frame in three layers, greedily in raster order at a distance, inside its disk and at least that part of its peak bright: (frame_id, ap_id, ax, ay, size)."""

    def kernel(a, _):
        e = ellipses(a)
        found = [kernels.poisson_grid(f, size, part, disk) for f, *disk in zip(a, e["cx"], e["cy"], e["semi_major"], strict=True)]
        return {"aps": [[{"ax": x, "ay": y, "size": s} for x, y, s in g] for g in found]}

    grids = per_stack(frames, kernel, "aps array<struct<ax:int,ay:int,size:int>>")
    return grids.select("frame_id", F.posexplode("aps").alias("ap_id", "p")).select("frame_id", "ap_id", "p.*")


def interpolated(scores: DataFrame, by: str, order: str, score: str) -> DataFrame:
    """Missing scores filled linearly between the neighbours in order; flat beyond the first and last.

    Rows are dealt by ranges of (by, order) and stored with their part, so that a group of any size is filled by all tasks. Parts pass on their
    first and last score; windows over a group see a row for each part. Both neighbours are the last ones seen, in order or against it, which
    takes one step a row.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(scores.repartitionByRange(parts, by, order).withColumn("_part", F.spark_partition_id()))
    known = F.when(F.col(score).isNotNull(), F.struct(F.col(order).alias("x"), F.col(score).alias("y")))
    ends = dealt.groupBy(F.col(by).alias("_group"), F.col("_part").alias("_of")).agg(F.min(known).alias("_first"), F.max(known).alias("_last"))
    of_group = Window.partitionBy("_group")
    earlier, later = (of_group.orderBy(at).rowsBetween(Window.unboundedPreceding, -1) for at in ("_of", F.desc("_of")))
    ends = ends.select("_group", "_of", F.last("_last", True).over(earlier).alias("_before"), F.last("_first", True).over(later).alias("_after"))
    rows = dealt.join(ends, (F.col("_part") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_group")))
    own = Window.partitionBy("_part", by)
    before, after = (own.orderBy(*at).rowsBetween(Window.unboundedPreceding, 0) for at in ((F.asc(order), F.asc(score)), (F.desc(order), F.desc(score))))
    found = rows.withColumn("_low", F.coalesce(F.last(known, True).over(before), "_before")).withColumn("_high", F.coalesce(F.last(known, True).over(after), "_after"))
    (x0, y0), (x1, y1) = ((F.col(f"{side}.x"), F.col(f"{side}.y")) for side in ("_low", "_high"))
    line = y0 + F.try_divide((y1 - y0) * (F.col(order) - x0), x1 - x0)
    return found.withColumn("filled", F.coalesce(F.col(score), line, y0, y1)).drop("_part", "_of", "_group", "_before", "_after", "_low", "_high")
