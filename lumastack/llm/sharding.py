"""Contiguous shards of near equal size, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumastack.llm.shared import materialise

#: Bits of a place that number the rows of a partition; those above are the partition's number.
ROW_BITS = 33


def ordered_rows(docs: DataFrame, id_col: str, text_col: str, overhead: int, *, whole_rows: bool) -> DataFrame:
    """(id, size, crc, at[, row: all columns]), stored in the global order: by id, crc32 and size, then by place in the input.

    Ranges of that order are the partitions, sorted; at is a row's place, partition and row in it. The place in the input
    lets an id that very many rows repeat fall into several ranges.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    size = F.octet_length(text).cast("bigint") + overhead
    keyed = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), *row, F.monotonically_increasing_id().alias("input"))
    order = ["id", "crc", "size", "input"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("input")
    return materialise(placed.withColumn("at", F.monotonically_increasing_id()))


def cell(twice: Column, total: Column, shards: int) -> Column:
    """Which of so many equal cells of a line of length total holds the point twice / 2, in exact integers."""
    wide = twice.cast("decimal(38,0)") * F.lit(shards), total.cast("decimal(38,0)") * F.lit(2)
    return F.least(F.call_function("div", *wide), F.lit(shards - 1)).cast("int")


def cuts_of(rows: DataFrame, weight: Column, shards: int) -> DataFrame:
    """(part, first_row, cuts) of every partition of ordered_rows: its rows before it, and where shards begin in it, as an array
    of (at, shard, start), start being the global row at which the shard begins.

    Partitions send their totals; prefix sums over these say between which targets a partition lies. Only those that hold a
    target sum up their own rows. A row belongs to the shard whose cell its middle falls in, so each cut is the boundary
    between two rows nearest to its target. There are as many rows as partitions, and cuts as partitions and shards.
    """
    part = F.shiftright("at", ROW_BITS).alias("part")
    each = rows.select(part, "at", weight.alias("w"))
    totals = each.groupBy("part").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("at").alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select("part", "w", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("start"), F.greatest(F.sum("w").over(Window.partitionBy()), F.lit(1)).alias("total"))
    sums = materialise(sums.withColumn("low", cell(2 * F.col("start"), F.col("total"), shards)).withColumn("high", cell(2 * (F.col("start") + F.col("w")), F.col("total"), shards)))

    plain = sums.where("low = high").select("part", "first_row", "at", F.col("low").alias("shard"))
    split = each.join(F.broadcast(sums.where("low <> high").select("part", "first_row", "start", "total")), "part")
    upto = F.sum("w").over(Window.partitionBy("part").orderBy("at"))
    own = split.withColumn("shard", cell(2 * (F.col("start") + upto) - F.col("w"), F.col("total"), shards))
    firsts = plain.unionByName(own.groupBy("part", "first_row", "shard").agg(F.min("at").alias("at")))
    firsts = materialise(firsts.withColumn("row", F.col("first_row") + (F.col("at") - F.shiftleft("part", ROW_BITS))))
    starts = firsts.groupBy("shard").agg(F.min("row").alias("start"))
    cuts = firsts.join(F.broadcast(starts), "shard").groupBy("part", "first_row")
    return cuts.agg(F.array_sort(F.collect_list(F.struct("at", "shard", "start"))).alias("cuts"))


def shard_documents(docs: DataFrame, shards: int, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, *, whole_rows: bool = False) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot; with whole_rows all columns of docs in a struct `row`.

    size is the UTF-8 bytes of the text plus overhead, text_crc32 that of its UTF-8. Documents in the order of their ids are
    cut into shards 0 to shards - 1, each a contiguous run; slot numbers a shard's documents from 0, gapless, in that order.
    Under the law `bytes` the cuts lie at equal sums of sizes, so a shard differs from the mean by less than the largest
    document; under `rows` at equal numbers of rows, so counts differ by one at most.

    Rows are ranged once by id; prefix sums go over partitions' totals, and only partitions that a cut falls in sum up their
    rows. What is broadcast is a row for each partition and an entry for each shard in it. A null text counts as empty; null ids come first;
    rows that repeat an id are ordered by crc32 and size, and those equal in all three as they are in the input. A document larger than
    the mean leaves shards without rows. No rows give no rows. Other columns, whatever their names, play no part.
    """
    weight = {"bytes": F.col("size"), "rows": F.lit(1).cast("bigint")}[law]
    rows = ordered_rows(docs, id_col, text_col, overhead, whole_rows=whole_rows)
    cuts = materialise(cuts_of(rows, weight, shards))
    place = F.element_at(F.filter("cuts", lambda c: c["at"] <= F.col("at")), -1)
    found = rows.withColumn("part", F.shiftright("at", ROW_BITS)).join(F.broadcast(cuts), "part").withColumn("place", place)
    slot = F.col("first_row") + F.col("at") - F.shiftleft("part", ROW_BITS) - F.col("place.start")
    return found.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("place.shard").alias("shard"), slot.alias("slot"), *(["row"] if whole_rows else []))


def write_shards(docs: DataFrame, path: str, shards: int, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> None:
    """docs, all columns, as Parquet files in folders _shard=k of path, each in the order of its slots (column _slot).

    The rows already lie in that order, so they are written without a second shuffle, a file for each partition of a shard.
    """
    found = shard_documents(docs, shards, law, id_col, text_col, overhead, whole_rows=True)
    out = found.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
