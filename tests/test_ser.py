"""Video files: written, read back, pruned, streamed."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual
from pyspark.sql.types import StructType

from lumastack.sources import ser


@pytest.fixture
def source(spark):
    spark.dataSource.register(ser.SerSource)
    return spark


def frames(spark, n=1203):
    r = np.random.default_rng(1)
    rows = [("a.ser" if i < n - 3 else "b.ser", i, 2, 3, r.random(6).tolist(), 1_700_000_000.0 + i / 8) for i in range(n)]
    rows += [(None, 1, 2, 3, [0.0] * 6, 0.0), ("a.ser", -1, 2, 3, [0.0] * 5, 0.0), ("c.ser", 5, 2, 3, [0.5, 2.0, -1.0, 0.0, 1.0, 0.25], None)]
    df = spark.createDataFrame(rows, "file string, frame_id long, h int, w int, px array<double>, t double")
    return df.withColumn("ts", F.timestamp_seconds("t")).repartition(4), rows


@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_what_is_written_is_read_back(source, tmp_path, depth, scheme):
    df, rows = frames(source)
    made = {r["file"]: r["frames"] for r in ser.write_ser(df, f"{scheme}{tmp_path}/out", depth=depth).collect()}
    assert made == {"a.ser": 1200, "b.ser": 3, "c.ser": 1} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.ser", "b.ser", "c.ser"]
    got = {(r["file"], r["frame_idx"]): r for r in source.read.format("ser").option("path", f"{scheme}{tmp_path}/out").load().withColumn("s", F.unix_micros(ser.frame_time("ts_ticks"))).collect()}
    good = [r for r in rows if r[0] and len(r[4]) == 6]
    assert len(got) == len(good)
    for name in ("a.ser", "b.ser", "c.ser"):
        for k, r in enumerate(sorted((r for r in good if r[0] == name), key=lambda r: r[1])):
            row = got[name, k]
            assert row["px"] == np.rint(np.clip(r[4], 0, 1) * (2**depth - 1)).tolist() and row["s"] == (None if r[5] is None else round(r[5] * 1e6))
    one = source.read.format("ser").option("path", f"{scheme}{tmp_path}/out/b.ser").load()
    assert one.count() == 3 and not one.where("ts_ticks IS NULL").count()


class Watched:
    """A file that tells how many bytes are read of it."""

    def __init__(self, file, log):
        self.file, self.log = file, log

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def size(self):
        return self.file.size()

    def read_at(self, n, at):
        self.log.append(n)
        return self.file.read_at(n, at)


def test_only_what_is_asked_for_is_read(source, tmp_path, monkeypatch):
    df, _ = frames(source)
    folder = str(tmp_path / "out")
    ser.write_ser(df, folder).collect()
    log, plain = [], ser.opened
    monkeypatch.setattr(ser, "opened", lambda path: (type("S", (), {"open_input_file": lambda _, p: Watched(plain(path)[0].open_input_file(p), log), "get_file_info": lambda _, p: plain(path)[0].get_file_info(p)})(), plain(path)[1]))

    def read(schema, *filters):
        log.clear()
        reader = ser.PushingSerReader({"path": folder}, StructType.fromDDL(schema))
        left = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        return rows, left, sum(log)

    whole, _, most = read(ser.SCHEMA)
    assert len(whole) == 1204 and most > 1204 * 12
    rows, left, n = read("frame_idx int, file string", GreaterThan(("frame_idx",), 9), LessThanOrEqual(("frame_idx",), 12), EqualTo(("file",), "a.ser"), IsNotNull(("file",)))
    assert rows == [(10, "a.ser"), (11, "a.ser"), (12, "a.ser")] and n == 2 * ser.HEADER and left == [IsNotNull(("file",))]
    rows, left, n = read("px array<double>", EqualTo(("frame_idx",), 2), In(("file",), ("a.ser", "b.ser", "x.ser")))
    assert len(rows) == 2 and not left and n == 4 * ser.HEADER + 2 * 12
    assert read(ser.SCHEMA, EqualTo(("file",), "a.ser"), EqualTo(("file",), "b.ser"))[0] == []
    with pytest.raises(ValueError, match="no column"):
        ser.SerReader({"path": folder}, StructType.fromDDL("moon int"))


@pytest.mark.parametrize("enabled", ["true", "false"])
def test_filters_and_options_reach_the_scan(source, tmp_path, enabled):
    df, _ = frames(source)
    ser.write_ser(df, str(tmp_path / "out")).collect()
    plain = source.read.format("ser").schema("file string, frame_idx int").option("path", str(tmp_path / "out"))
    source.conf.set("spark.sql.python.filterPushdown.enabled", enabled)
    try:
        if enabled == "true":
            some = plain.option("pushdown", "true").load().where((F.col("frame_idx") >= 1198) & (F.col("file") == "a.ser") & (F.col("file") != "x"))
            assert sorted(r["frame_idx"] for r in some.collect()) == [1198, 1199]
            assert "frame_idx" in some._jdf.queryExecution().executedPlan().toString()
            assert plain.load().where("frame_idx < 0").count() == 0 and plain.load().where("frame_idx = 1 OR file = 'c.ser'").count() == 3
        read = source.read.format("ser").schema("file string, frame_idx int").option("path", str(tmp_path / "out")).load()
        assert [read.where(f).count() for f in ("frame_idx < 0", "frame_idx = 1 OR file = 'c.ser'", "frame_idx > 1198 AND file = 'a.ser'", "true")] == [0, 3, 1, 1204]
        ranged = source.read.format("ser").schema("file string, frame_idx int").option("path", str(tmp_path / "out")).option("first", 1).option("last", 2).option("files", "a.ser,c.ser").load()
        assert sorted(map(tuple, ranged.collect())) == [("a.ser", 1), ("a.ser", 2)]
    finally:
        source.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_goes_on_where_it_was(source, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"

    def write(name, n, first=0):
        px = np.full((n, 2, 2), 7, "u1")
        (folder / name).write_bytes(b"LUCAM-RECORDER" + struct.pack("<7I", 0, 0, 0, 2, 2, 8, n) + b"\0" * 136 + px.tobytes())

    def run():
        stream = source.readStream.format("ser").schema("file string, frame_idx int").option("path", str(folder)).load()
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, source.read.schema("file string, frame_idx int").parquet(str(out)).collect()))

    folder.mkdir()
    write("a.ser", 3)
    assert run() == [("a.ser", 0), ("a.ser", 1), ("a.ser", 2)]
    write("a.ser", 5)  # grows
    write("0.ser", 2)  # comes later under an earlier name
    want = sorted([("a.ser", i) for i in range(5)] + [("0.ser", 0), ("0.ser", 1)])
    assert run() == want and run() == want


def test_frames_of_unlike_sizes_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([("a.ser", 0, 1, 2, [0.0, 0.0]), ("a.ser", 1, 2, 1, [0.0, 0.0])], "file string, frame_id long, h int, w int, px array<double>")
    with pytest.raises(Exception, match="differ in size"):
        ser.write_ser(df, str(tmp_path)).collect()
    assert ser.write_ser(df.limit(0), str(tmp_path)).count() == 0


def test_a_file_whose_frames_come_from_many_tasks_is_whole(source, tmp_path):
    """A join that turns out small as it runs is done without dealing the frames anew; a file must still come through one task."""
    df = source.range(4000).select(F.concat((F.col("id") % 2).cast("string"), F.lit(".ser")).alias("file"), F.col("id").alias("frame_id"), F.lit(2).alias("h"), F.lit(3).alias("w"), F.array_repeat(F.col("id") / 4000, 6).alias("px"), F.timestamp_seconds("id").alias("ts"))
    source.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    source.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        for name, rows in (("wide", df.repartition(16)), ("dealt", df.repartition(16).join(df.select("file").distinct(), "file"))):
            folder = f"{tmp_path}/{name}"
            assert {tuple(r) for r in ser.write_ser(rows, folder).collect()} == {("0.ser", 2000), ("1.ser", 2000)}
            got = source.read.format("ser").option("path", folder).load().groupBy("file").agg(F.count("ts_ticks"), F.unix_seconds(F.max(ser.frame_time("ts_ticks"))), F.countDistinct("px"))
            assert sorted(map(tuple, got.collect())) == [("0.ser", 2000, 3998, 2000), ("1.ser", 2000, 3999, 2000)]
    finally:
        source.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        source.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_a_file_without_all_its_frames_is_an_error(tmp_path):
    sink = ser.Sink(str(tmp_path), "a.ser", 8)
    sink.open(2, 1, 2, 0)
    sink.add([0.0, 1.0], 5)
    with pytest.raises(ValueError, match="1 of 2 frames"):
        sink.close()
    assert not (tmp_path / "a.ser").exists()
