"""Structured Streaming forms of the catalog and series operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumastack.sources.shared import shared_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files: the folder's part files, or the one file of that name."""
    path = f"{sf_dir}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def capture_counts(rows: DataFrame) -> DataFrame:
    """Running counts of captures by session and filter as files land."""
    return rows.groupBy("session", "filter").agg(F.count("*").alias("n"))


def cycle_counts(rows: DataFrame, minutes: float, late: str = "10 minutes", origin: str = "0 seconds") -> DataFrame:
    """Captures of each cycle and filter by event time; rows later than `late` behind the newest are dropped. The origin is a parameter, since a stream has no smallest time."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    width = f"{int(minutes * 60)} seconds"
    return timed.groupBy(F.window("ts", width, width, origin), "filter").agg(F.count("*").alias("n")).select("filter", F.col("window.start").alias("start"), "n")


def islands(rows: DataFrame, minutes: float) -> DataFrame:
    """Runs of captures of a filter without a gap over two cycles, as session windows; works on a stream and on a table."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", "10 minutes") if rows.isStreaming else timed
    gap = f"{int(2 * minutes * 60)} seconds"
    return timed.groupBy(F.session_window("ts", gap), "filter").agg(F.count("*").alias("n")).select("filter", F.col("session_window.start").alias("start"), "n")


def size_gate_stream(rows: DataFrame, window: int = 100, tolerance: float = 0.05, start: int = 20) -> DataFrame:
    """The size gate as keyed state: rows (file_id, frame_idx, bw, bh); adds accepted. A file's frames must not come back behind
    an earlier batch; within a batch they are taken in order. The state of a file is the list of its last `window` accepted sizes.
    """
    import pandas as pd

    from lumastack.operators.frames import SizeGate

    def gate(key, parts, state):
        ws, hs = map(list, state.get) if state.exists else ([], [])
        own = SizeGate(window, tolerance, start, ws, hs)
        pdf = pd.concat(list(parts)).sort_values(["frame_idx", "bw", "bh"])
        flags = [own.accepts(w, h) for w, h in zip(pdf["bw"], pdf["bh"], strict=True)]
        state.update((own.ws, own.hs))
        yield pdf[["file_id", "frame_idx"]].assign(accepted=flags)

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in ("file_id", "frame_idx"))
    return rows.groupBy("file_id").applyInPandasWithState(gate, f"{kinds}, accepted boolean", "ws array<double>, hs array<double>", "append", "NoTimeout")


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that is there now run through a stream, as a table of files in the shared folder.

    Complete mode keeps the last batch, which has the whole result; append mode keeps all, each in its own folder, so that a
    batch run again replaces itself.
    """
    if mode not in ("complete", "append"):
        raise ValueError(f"mode {mode} has no table")
    spark, ran = stream.sparkSession, []
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    rows = f"{folder}/rows"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(rows if mode == "complete" else f"{rows}/{batch_id}")
        ran.append(batch_id)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not ran:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(rows)
