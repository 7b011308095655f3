"""Best-fit decreasing packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumastack.llm.bpe import word_coder
from lumastack.llm.shared import doc_chunks, gather, materialise, text_blocks, words_of


class CapacityTree:
    """A segment tree over remaining capacities 0..size: it finds the tightest open bin with room in logarithmic time.

    A leaf holds the groups of bins with that much room left. A group is a run of sequence ids filled alike.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, room: int, first: int, bins: int) -> None:
        self.groups[room].append((first, bins))
        self._change(room, bins)

    def take(self, room: int) -> tuple[int, int]:
        first, bins = self.groups[room].pop()
        self._change(room, -bins)
        return first, bins

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least need that an open bin has."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over all pieces, given how many there are of each length.

    Pieces of one length are alike, so those that go into bins filled alike are placed together; the result is that of
    placing them singly, longest first, each into the tightest bin with room. A bin that takes one piece stays the
    tightest for the next of that length, so it is filled up before another is used. Each length adds at most two groups
    of bins, and a bin has fewer than 100 distinct lengths, so the plan is bounded by size, whatever the corpus.

    Returns rows (length, first rank, pieces, pieces a bin, first sequence, offset in the sequence).
    """
    tree, plan, opened = CapacityTree(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = size
                first, bins = opened, -(-left // (size // length))
                opened += bins
            else:
                first, bins = tree.take(room)
            each = room // length
            full = min(bins, left // each)
            if full:
                plan.append((length, rank, full * each, each, first, size - room))
                tree.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins:
                if left:  # fewer than fill a bin
                    plan.append((length, rank, left, left, first + full, size - room))
                    tree.add(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                if full < bins:
                    tree.add(room, first + full, bins - full)
    return plan


def pack(pieces: DataFrame, size: int, keys: list[str], length_col: str = "length", buckets: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset: best-fit decreasing into sequences of at most size.

    The driver plans from the histogram of lengths (at most size rows); the pieces themselves stay distributed. Each piece
    gets its rank among those of its length from counts by (bucket, length) and its place in its bucket, so a length that
    a third of all pieces have is dealt over all buckets. pieces should be a stored table: it is read three times. keys
    order the pieces; rows equal in all keys may change places. A null, negative or too long length is an error; a length
    of 0 gets sequence and offset 0. Without pieces the result has no rows.
    """
    spark = pieces.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.col(length_col)
    checked = F.when(length.between(0, size), length).otherwise(F.raise_error(F.lit(f"a piece needs a length from 0 to {size}")))
    salted = pieces.withColumn("_length", checked).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    per_bucket = materialise(salted.groupBy("_bucket", "_length").agg(F.count("*").alias("_n")))
    counts = {r["_length"]: r["n"] for r in per_bucket.groupBy("_length").agg(F.sum("_n").alias("n")).collect() if r["_length"]}
    plan = np.array(best_fit_plan(counts, size), np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])

    before = F.sum("_n").over(Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_bucket.select("_bucket", "_length", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket", "_length").orderBy(*keys)) - 1
    ranked = salted.withColumn("_own", own).join(starts, ["_bucket", "_length"]).withColumn("_rank", F.col("_own") + F.col("_before"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths, ranks):
        import pandas as pd

        p, n, r = plan.value, lengths.to_numpy(), ranks.to_numpy()
        if not len(p):
            return pd.DataFrame({"sequence_id": n * 0, "offset": n * 0})
        top = int(p[:, 1].max()) + int(r.max()) + 1
        row = p[np.maximum(0, np.searchsorted(p[:, 0] * top + p[:, 1], n * top + r, side="right") - 1)]
        rank = r - row[:, 1]
        return pd.DataFrame({"sequence_id": np.where(n > 0, row[:, 4] + rank // row[:, 3], 0), "offset": np.where(n > 0, row[:, 5] + rank % row[:, 3] * n, 0)})

    placed = ranked.withColumn("_at", place(F.col("_length").cast("long"), F.col("_rank").cast("long")))
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = False) -> DataFrame:
    """The token ids of each text and a closing end_id, cut into pieces of at most size: (id, piece, start, length, ids_crc32[, ids]).

    A null text counts as empty and has one piece, of end_id alone. Each distinct word of a block is coded once.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for block in text_blocks(batches):
            words, flat, starts = words_of(block.column("text"))
            values, at = coder.encode(words.to_pylist())
            values = values.astype("<u4")
            out = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for first, last in doc_chunks(starts):
                chunk = flat[starts[first] : starts[last]]
                tokens = gather(values, at, chunk)
                ends = np.concatenate(([0], np.cumsum((at[1:] - at[:-1])[chunk])))[starts[first : last + 1] - starts[first]]
                for row, i, j in zip(range(first, last), ends, ends[1:], strict=False):
                    whole = np.append(tokens[i:j], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), size)):
                        own = whole[start : start + size]
                        for k, v in zip(out, (row, piece, start, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32) if ids else None), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict({"id": block.column("id").take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32()), "start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int64()), "ids_crc32": pa.array(out["ids_crc32"], pa.int64())} | ({"ids": pa.array(out["ids"], pa.list_(pa.int32()))} if ids else {}))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return rows.mapInArrow(blocks, schema).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = False) -> DataFrame:
    """Documents tokenised, cut and packed: the rows of token_pieces with sequence_id and offset.

    Rows that repeat an id are packed as documents of their own. With ids, each row carries its tokens, ready to be laid
    out by sequence_id and offset.
    """
    pieces = materialise(token_pieces(docs, path, size, end_id, id_col, text_col, ids=ids))
    return pack(pieces, size, [id_col, "piece", "ids_crc32"])


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack_documents(ids=True): sequence_id and its ids, at most size of them."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", F.flatten("held.ids").alias("ids"))
