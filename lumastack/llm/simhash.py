"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumastack.llm.graph import components
from lumastack.llm.shared import materialise

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, size: int = 3, part: int = 100_000) -> int:
    """The 64-bit fingerprint of a text: bit b is 1 if set in over half the XXH64 (seed 42) of its shingles of `size` words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    size = min(size, len(words))
    joined, starts = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])
    n = len(words) - size + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, part):
        j = min(n, i + part)
        spans = zip(starts[i:j].tolist(), (starts[i + size : j + size] - 1).tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, fingerprint as a signed bigint), one row per document. Null and empty texts have fingerprint 0."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), size) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*batch.schema.names[:-1], "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), *carry, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(blocks, T.StructType([*rows.schema.fields[:-1], T.StructField("fingerprint", T.LongType())]))


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `distance` bits, from a column fingerprint.

    Multi-index hashing: two fingerprints that near are within distance // 2 bits of each other in one of their two 32-bit
    halves. Each fingerprint is stored under both its halves and looks up every value in the small Hamming ball around
    them (33 for each half at distance 3); complete distances decide. 32-bit keys keep the matches few: about n / 130
    million chance matches for each of n fingerprints. Spark does not count what explode adds (66 rows for each fingerprint), so
    without the hint it would broadcast them.
    """
    radius = distance // 2
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(32), r)]
    low = F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(F.col("fingerprint"), 32).bitwiseOR(F.lit(1 << 32))  # bit 32 says which half a key is of
    stored = nodes.select(F.explode(F.array(low, high)).alias("key"), F.col("fingerprint").alias("b"))
    ball = F.array(*[F.lit(m).cast("bigint") for m in masks])
    looked = nodes.select("fingerprint", F.explode(F.array(low, high)).alias("half"), ball.alias("ball")).select(F.col("fingerprint").alias("a"), F.explode("ball").alias("mask"), "half").select("a", F.col("half").bitwiseXOR(F.col("mask")).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return looked.join(stored.hint("merge"), "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_groups(docs: DataFrame, distance: int = 3, size: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), *, with_root: bool = False) -> DataFrame:
    """One row per document: id, carried columns, fingerprint (bigint) and component_id, the smallest id that links reach; with with_root also
    root, a fingerprint that names the component (two components have one id where that id has several texts).

    Documents with one fingerprint are one node, so large groups of copies cost one row each; only links between different
    fingerprints are made. Components are found by contraction (lumastack.llm.graph). Null ids are never the component's
    id unless it has no other; repeated rows share a fingerprint and thus a component.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, size, carry))
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fingerprint"), distance))
    named = materialise(nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))
    best = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = materialise(named.join(best, "root").select("fingerprint", "component_id", "root"))
    return prints.join(named, "fingerprint").select(F.col("id").alias(id_col), *carry, "fingerprint", "component_id", *["root"] * with_root)
