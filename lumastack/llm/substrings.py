"""Repeated passages: seed and extend over winnowed anchors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.llm.shared import words_of

#: Text of one block of documents; a task holds one block at a time, in some 15 times its size.
PASSAGE_BLOCK = 12 << 20
NO_ID = np.int64(2**63 - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash stirred, so that the smallest of several is a random one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def runs_hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place of at."""
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
    return mixed(h)


class Block:
    """The windows of a block of documents, and what it asks of others about them."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        ids = table.column("id").combine_chunks()
        self.ids = ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        self.window = window
        text = table.column("text").combine_chunks()
        self.words, self.places, self.starts = words_of(text)
        digest = b"".join(map(xxhash.xxh3_128_digest, self.words.cast(pa.large_binary()).to_pylist()))
        self.hashes = np.frombuffer(digest, ">u8").astype(np.uint64).reshape(-1, 2)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))
        n = len(doc) - window + 1
        at = np.flatnonzero(doc[:n] == doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.at, self.doc = at, doc[at]  # each window's first word and document
        if not len(at):
            self.anchor = self.asked = np.zeros(0, np.uint64)
            self.local = np.zeros(0, bool)
            return
        first = self.hashes[:, 0][self.places]
        low = runs_hash(first, np.arange(len(doc) - gram + 1), gram)
        span, done = window - gram + 1, 1  # the smallest gram hash of each window: its anchor
        while done < span:
            step = min(done, span - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        self.anchor = low[at]
        new = np.concatenate(([True], (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])))
        a, d = self.anchor[new], self.doc[new]
        order = np.lexsort((d, a))
        a, d = a[order], d[order]
        new = np.concatenate(([True], a[1:] != a[:-1]))
        self.asked = a[new]
        self.local = np.zeros(len(self.asked), bool)  # anchors that two documents of this block share
        self.local[(np.cumsum(new) - 1)[1:][(a[1:] == a[:-1]) & (d[1:] != d[:-1])]] = True

    def extend(self, shared: np.ndarray) -> None:
        """Keep the windows around shared anchors; find the distinct ones and the smallest id that each stands in."""
        seeded = (self.local | shared)[np.searchsorted(self.asked, self.anchor)] if len(self.at) else np.zeros(0, bool)
        self.at, self.doc = self.at[seeded], self.doc[seeded]
        h1, h2 = (runs_hash(self.hashes[:, k][self.places], self.at, self.window) for k in (0, 1))
        order = np.lexsort((h2, h1))
        new = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))) if len(order) else np.zeros(0, bool)
        self.of = np.empty(len(order), np.int64)  # each window's place among the distinct ones
        self.of[order] = np.cumsum(new) - 1
        self.h1, self.h2 = h1[order][new], h2[order][new]
        self.least = np.full(len(self.h1), NO_ID)
        np.minimum.at(self.least, self.of, self.ids[self.doc])

    def remove(self, least: np.ndarray) -> Iterator[dict]:
        """For each document its words, the runs of them to remove and the text that is left."""
        n = len(self.places)
        gone = self.at[least[self.of] < self.ids[self.doc]] if len(self.at) else self.at
        covered = np.cumsum(np.bincount(gone, minlength=n + 1)[: n + 1] - np.bincount(gone + self.window, minlength=n + 1)[: n + 1])[:n] > 0
        words = self.words
        for i, (first, last) in enumerate(zip(self.starts, self.starts[1:], strict=False)):
            own = covered[first:last]
            kept = self.places[first:last][~own]
            spans = []
            if own.any():
                edge = np.diff(np.concatenate(([0], own.view(np.int8), [0])))
                spans = np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), 1).tolist()
            yield {"row": i, "n_words": int(last - first), "n_removed": int(own.sum()), "spans": [{"start": s, "end": e} for s, e in spans], "kept_text": " ".join(words.take(pa.array(kept)).to_pylist())}


def dealt(block: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> dict:
    """Columns cut by bucket of the key, a row for each bucket: what one block sends to the others' meeting points."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(b, i, j) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
    data = [b"".join(c[order[i:j]].tobytes() for c in columns) for _, i, j in rows]
    return {"bucket": pa.array([b for b, _, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "data": pa.array(data, pa.binary())}


def answers(table: pa.Table, kind: int, buckets: int, keys: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each answer of a kind: the places of keys that its block had asked about, and the answer."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k, b, data in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True):
        if k == kind:
            yield order[cuts[b] : cuts[b + 1]], data


def remove_repeats(docs: DataFrame, window: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = PASSAGE_BLOCK) -> DataFrame:
    """Remove every word covered by a run of `window` words that also stands in a document with a smaller id.

    Returns per document: id, n_words, n_removed, spans (maximal repeats as word ranges, end exclusive) and kept_text (the
    words left, joined by one space). Words are runs without ASCII white space; all windows are judged on the input.

    Seed: the anchor of a window is the smallest hash of its `gram`-word runs, so equal windows have equal anchors and
    neighbours mostly share one. Documents are dealt into blocks. A block asks about each of its anchors once; an anchor
    that a second block or document has is a seed. Extend: only windows around seeds go on, by 128-bit hashes, each
    distinct one once from a block with its smallest id; the answer is a smaller id elsewhere. Covered words are then
    merged into maximal repeats. A passage in a third of all documents is a single entry from each block; an answer is a
    bit for each entry asked. The blocks' texts are shuffled once, and that exchange is used again for all three passes.
    Blocks times meeting points bound the rows sent; with very many blocks raise block_bytes.

    Null texts have no words. Rows without an id yield to every other but not to one another; rows that repeat an id do not
    remove from one another. Ids are integers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    sent = "bucket int, block int, data binary"
    back = "block int, kind int, bucket int, data binary"

    def ask_anchors(table: pa.Table) -> pa.Table:
        own = Block(table, window, gram)
        return pa.table(dealt(table.column("block")[0].as_py(), blocks, own.asked, own.asked))

    def find_shared(table: pa.Table) -> pa.Table:
        data = table.column("data").to_pylist()
        keys = np.frombuffer(b"".join(data), np.uint64)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        shared = np.zeros(len(keys), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        ends = np.cumsum([0, *(len(d) // 8 for d in data)])
        bits = [np.packbits(shared[i:j]).tobytes() for i, j in zip(ends, ends[1:], strict=False)]
        return pa.table({"block": table.column("block"), "kind": pa.array([1] * len(data), pa.int32()), "bucket": table.column("bucket"), "data": pa.array(bits, pa.binary())})

    def extended(table: pa.Table, got: pa.Table) -> Block:
        own = Block(table, window, gram)
        shared = np.zeros(len(own.asked), bool)
        for places, data in answers(got, 1, blocks, own.asked):
            shared[places] = np.unpackbits(np.frombuffer(data, np.uint8), count=len(places)).astype(bool)
        own.extend(shared)
        return own

    def ask_windows(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table(dealt(0, blocks, np.zeros(0, np.uint64)))
        own = extended(table, got)
        return pa.table(dealt(table.column("block")[0].as_py(), blocks, own.h1, own.h1, own.h2, own.least))

    def find_least(table: pa.Table) -> pa.Table:
        data = table.column("data").to_pylist()
        ends = np.cumsum([0, *(len(d) // 24 for d in data)])
        parts = [np.frombuffer(d, np.uint64).reshape(3, -1) for d in data]
        h1, h2, least = np.concatenate(parts, axis=1)
        least = least.view(np.int64)
        order = np.lexsort((least, h2, h1))
        new = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))
        best = np.empty(len(order), np.int64)
        best[order] = least[order][new][np.cumsum(new) - 1]
        smaller = best < least
        out = [np.packbits(smaller[i:j]).tobytes() + best[i:j][smaller[i:j]].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
        return pa.table({"block": table.column("block"), "kind": pa.array([2] * len(data), pa.int32()), "bucket": table.column("bucket"), "data": pa.array(out, pa.binary())})

    def judge(table: pa.Table, got: pa.Table) -> pa.Table:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept_text", pa.string())]
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64())} | {k: pa.array([], t) for k, t in fields})
        own = extended(table, got)
        least = own.least.copy()
        for places, data in answers(got, 2, blocks, own.h1):
            size = -(-len(places) // 8)
            smaller = np.unpackbits(np.frombuffer(data, np.uint8, size), count=len(places)).astype(bool)
            least[places[smaller]] = np.frombuffer(data, np.int64, offset=size)
        out = list(own.remove(least))
        return pa.table({"id": table.column("id")} | {k: pa.array([r[k] for r in out], t) for k, t in fields})

    shared = rows.groupBy("block").applyInArrow(ask_anchors, sent).groupBy("bucket").applyInArrow(find_shared, back)
    least = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(ask_windows, sent).groupBy("bucket").applyInArrow(find_least, back)
    told = shared.unionByName(least)
    result = "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_text string"
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(judge, result).withColumnRenamed("id", id_col)
