"""Video files (a header of 178 bytes, raw frames, optional timestamps) as a Spark data source, batch and stream, and as files to write.

    spark.dataSource.register(SerSource)
    spark.read.format("ser").option("path", folder_or_file).load()
    spark.readStream.format("ser").option("path", folder).load()

Paths are local ones or URIs of any file system that pyarrow opens (file, s3, gs, hdfs), on the driver and the executors alike.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

HEADER = 178
#: Frames in one partition.
FRAMES = 500
SCHEMA = "file string, frame_idx int, ts_ticks bigint, color_id int, h int, w int, px array<double>"
#: Ticks of 100 ns from the year 1 to 1970.
EPOCH_TICKS = 621_355_968_000_000_000


def header(data: bytes) -> dict:
    """The fixed fields of a header, little-endian. The endianness flag is not looked at, as frames are read the same either way."""
    color, _, width, height, depth, count = struct.unpack_from("<6I", data, 18)
    return {"color_id": color, "w": width, "h": height, "depth": depth, "count": count, "bytes": 1 if depth <= 8 else 2}


def opened(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_in(path: str) -> list[str]:
    """The .ser files of a folder, by name, or the one file."""
    from pyarrow import fs

    system, inner = opened(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name.endswith(".ser"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def header_of(path: str) -> dict:
    system, inner = opened(path)
    with system.open_input_file(inner) as file:
        return header(file.read_at(HEADER, 0))


def name_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))


def ranges(path: str, first: int, last: int) -> list[Range]:
    return [Range(path, i, min(last, i + FRAMES)) for i in range(first, last, FRAMES)]


def rows_of(path: str, first: int, last: int, columns: list[str]) -> Iterator[tuple]:
    """The frames first to last of a file. Only what the columns need is read: the header, the timestamps of these frames, their pixels."""
    import numpy as np

    if first >= last:
        return
    system, inner = opened(path)
    with system.open_input_file(inner) as file:
        own = header(file.read_at(HEADER, 0))
        size = own["w"] * own["h"] * own["bytes"]
        trailer = HEADER + own["count"] * size
        ticks = [None] * (last - first)
        if "ts_ticks" in columns and file.size() >= trailer + 8 * own["count"]:
            ticks = list(struct.unpack(f"<{last - first}Q", file.read_at(8 * (last - first), trailer + 8 * first)))
        for i in range(first, last):
            fixed = {"file": name_of(path), "frame_idx": i, "ts_ticks": ticks[i - first], "color_id": own["color_id"], "h": own["h"], "w": own["w"]}
            if "px" in columns:
                fixed["px"] = np.frombuffer(file.read_at(size, HEADER + i * size), "u1" if own["bytes"] == 1 else "<u2").astype(float).tolist()
            yield tuple(fixed[c] for c in columns)


class SerSource(DataSource):
    """One row per frame; pixels as values of 0..255 or 0..65535, ts_ticks null without a trailer.

    A schema given by the reader may name any of the columns, in any order; without px no pixel is read. Options `first`, `last` (frames, both
    included) and `files` (names with commas between) say which frames are read and which files are opened. With the option `pushdown`, and
    spark.sql.python.filterPushdown.enabled, comparisons of frame_idx and file do so too; Spark 4.1 keeps what one query has pushed
    for the next one of the same DataFrame, so such a DataFrame is to be loaded for each query.
    """

    @classmethod
    def name(cls):
        return "ser"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        pushing = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushingSerReader if pushing else SerReader)(self.options, schema)

    def streamReader(self, schema):
        return SerStreamReader(self.options, schema)


def columns_of(schema: StructType) -> list[str]:
    known = {c.split()[0] for c in SCHEMA.split(", ")}
    if unknown := set(schema.names) - known:
        raise ValueError(f"video files have no column {', '.join(sorted(unknown))}")
    return schema.names


class SerReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], columns_of(schema)
        self.names: set[str] | None = set(options["files"].split(",")) if "files" in options else None
        self.low, self.high = max(0, int(options.get("first", 0))), int(options.get("last", 2**31)) + 1

    def partitions(self):
        parts = []
        for path in files_in(self.path):
            if self.names is None or name_of(path) in self.names:
                parts += ranges(path, self.low, min(self.high, header_of(path)["count"]))
        return parts or [Range("", 0, 0)]

    def read(self, partition):
        yield from rows_of(*partition.value, self.columns)


class PushingSerReader(SerReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of frame_idx and equality of file; leaves the rest to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("frame_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            elif column == ("file",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f


class SerStreamReader(DataSourceStreamReader):
    """Frames of a folder as its files come and grow. The offset is how many frames of each file are done, by file name; a file that shrinks
    or goes gives no rows again."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], columns_of(schema)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name_of(f): header_of(f)["count"] for f in files_in(self.path)}

    def partitions(self, start: dict, end: dict):
        here = {name_of(f): f for f in files_in(self.path)}
        return [r for name, n in sorted(end.items()) if name in here for r in ranges(here[name], start.get(name, 0), n)]

    def read(self, partition):
        yield from rows_of(*partition.value, self.columns)


def frame_time(ts_ticks):
    """The time of a frame (UTC) from its ticks; null without ticks or before 1970."""
    micros = F.expr(f"({ts_ticks} - {EPOCH_TICKS}) div 10")
    return F.when(F.col(ts_ticks) >= EPOCH_TICKS, F.timestamp_micros(micros))


@dataclass
class Sink:
    """A file that is being written under another name, and renamed when it is whole."""

    folder: str
    name: str
    depth: int

    def open(self, n: int, h: int, w: int, color_id: int) -> None:
        from pyspark import TaskContext

        self.system, inner = opened(self.folder)
        self.system.create_dir(inner, recursive=True)
        context = TaskContext.get()
        self.final, self.part = f"{inner}/{self.name}", f"{inner}/.{self.name}.{context.taskAttemptId() if context else 0}"
        self.out, self.ticks, self.done, self.n, self.bytes = self.system.open_output_stream(self.part), [], 0, n, 1 if self.depth <= 8 else 2
        self.out.write(b"LUCAM-RECORDER" + struct.pack("<7I", 0, color_id, 0, w, h, self.depth, n) + b"\0" * 136)

    def add(self, px, ticks: int | None) -> None:
        import numpy as np

        self.out.write(np.rint(np.clip(px, 0, 1) * (2**self.depth - 1)).astype("u1" if self.bytes == 1 else "<u2").tobytes())
        self.ticks.append(ticks)
        self.done += 1

    def close(self) -> int:
        if self.done != self.n:
            raise ValueError(f"{self.name} has {self.done} of {self.n} frames")
        if None not in self.ticks:
            self.out.write(struct.pack(f"<{len(self.ticks)}Q", *self.ticks))
        self.out.close()
        self.system.move(self.part, self.final)
        return self.done


def write_ser(frames: DataFrame, folder: str, order: str = "frame_id", depth: int = 16) -> DataFrame:
    """Writes frames (file, h, w, px of 0..1, `order`; ts, a timestamp in UTC, if there is one) as a file for each value of `file`, and returns (file, frames).

    A file's frames come in order through one task, one at a time, since a file is one object; their number is counted before, and comes
    ahead of them as a row of its own. Rows are dealt by a number made of the file's name: a join or grouping by the name itself would let
    Spark leave out this exchange and split what it has dealt before. A file that has not all its frames is an error.
    A task that is tried again writes its files anew. Files of one name are replaced. Frames without a file, or with pixels that are null
    or fewer or more than h times w, are left out; all frames of a file must have one size. A frame without ts leaves its file without timestamps.
    """
    timed = F.expr(f"unix_micros(cast(ts as timestamp)) * 10 + {EPOCH_TICKS}") if "ts" in frames.columns else F.lit(None).cast("bigint")
    rows = frames.where(F.col("file").isNotNull() & (F.size("px") == F.col("h") * F.col("w"))).select(F.col("file").cast("string").alias("file"), F.col(order).alias("at"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), timed.alias("ticks"), F.col("px").cast("array<double>").alias("px"))
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    both = sizes.unionByName(rows.withColumn("n", F.lit(None).cast("bigint")), allowMissingColumns=True)

    def write(batches):
        import pyarrow as pa

        now, shape = None, None
        for batch in batches:
            pixels = batch.column("px")
            for i, row in enumerate(batch.drop_columns("px").to_pylist()):
                if row["n"] is not None:
                    if now:
                        yield pa.RecordBatch.from_pydict({"file": [now.name], "frames": [now.close()]})
                    now, n, shape = Sink(folder, row["file"], depth), row["n"], None
                    continue
                if now is None or row["file"] != now.name:
                    raise ValueError(f"frames of {row['file']} came without their number")
                if shape is None:
                    shape = row["h"], row["w"]
                    now.open(n, *shape, 0)
                if (row["h"], row["w"]) != shape:
                    raise ValueError(f"frames of {now.name} differ in size")
                now.add(pixels[i].values.to_numpy(zero_copy_only=False), row["ticks"])
        if now:
            yield pa.RecordBatch.from_pydict({"file": [now.name], "frames": [now.close()]})

    dealt = both.withColumn("_deal", F.xxhash64("file")).repartition("_deal").sortWithinPartitions("_deal", "file", F.desc_nulls_last("n"), "at").drop("_deal")
    return dealt.mapInArrow(write, "file string, frames bigint")
