"""Minimal perfect hashing of 64-bit keys, and counts of keys as dense vectors over it, in shards of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumastack.llm.shared import materialise

#: Keys of a shard on average: its vector of counts has 32 KB.
SHARD_KEYS = 4096
#: Bits of a level for each key that it is offered, and levels at most (a level leaves about four keys of ten).
SPREAD, LEVELS = 1.5, 64
#: A universal hash of both halves of a key, the same in columns and in arrays: products stay below 2^62.
PRIME, LEFT, RIGHT = 2**31 - 1, 1_580_030_173, 1_181_783_497


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> 32) % PRIME * LEFT + (keys & 0xFFFFFFFF) % PRIME * RIGHT) % PRIME % shards


def shard_column(key: Column, shards: int) -> Column:
    return (F.shiftright(key, 32) % PRIME * LEFT + key.bitwiseAND(F.lit(0xFFFFFFFF)) % PRIME * RIGHT) % PRIME % shards


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Another hash of the keys for each level."""
    h = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class PerfectHash:
    """Minimal perfect hashes of one or more shards of keys, numbered on from shard to shard.

    A shard has levels of bits. A key that is alone at its bit of a level sets it; keys that meet there go on to the next level.
    So each key has one bit, and its number is how many bits are set before it. first and size (shards, levels) say where a
    level's bits begin and how many there are, words holds the bits of all levels and shards, before the bits set before each word.
    """

    first: np.ndarray
    size: np.ndarray
    words: np.ndarray
    before: np.ndarray

    @staticmethod
    def levels(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The sizes in bits of a shard's levels, multiples of 64, and the words of all; keys must be distinct."""
        sizes, words = [], []
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("keys must be distinct")
            size = -(-int(SPREAD * len(keys)) // 64) * 64 or 64
            at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return sizes, np.concatenate([np.zeros(0, np.uint64), *words])

    @classmethod
    def of(cls, sizes: list[list[int]], words: list[np.ndarray]) -> PerfectHash:
        """From the levels of each shard."""
        table = np.zeros((len(sizes), max([1, *map(len, sizes)])), np.int64)
        for i, own in enumerate(sizes):
            table[i, : len(own)] = own
        ends = np.cumsum(table.ravel()).reshape(table.shape)
        flat = np.append(np.concatenate([np.zeros(0, np.uint64), *words]), np.uint64(0))
        return cls(ends - table, table, flat, np.concatenate(([0], np.cumsum(np.bitwise_count(flat[:-1]), dtype=np.int64))))

    def numbers(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """The number of each key of a shard, from 0, all different; -1 or any number for keys that were not hashed."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(self.size.shape[1]):
            size = self.size[shards[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            bit = self.first[shards[left], level] + (mixed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, mask = bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64)
            hit = (self.words[word] & mask) != 0
            below = np.bitwise_count(self.words[word] & (mask - np.uint64(1)))
            out[left[hit]] = (self.before[word] + below)[hit]
            left = left[~hit]
        return out


@dataclass
class Counts:
    """Counts by key: a perfect hash, and under each key's number the key itself (so that others are known as such) and its count."""

    hashes: PerfectHash
    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Counts:
        """From all rows of counted()."""
        table = table.sort_by("shard").combine_chunks()
        if not table.num_rows:
            return cls(PerfectHash.of([[]], []), np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, counts = (np.concatenate([c.flatten().to_numpy() for c in table.column(k).chunks]) for k in ("keys", "counts"))
        sizes, words = [[]] * (table.column("shard")[-1].as_py() + 1), []
        for shard, own, bits in zip(*(table.column(k).to_pylist() for k in ("shard", "sizes", "bits")), strict=True):
            sizes[shard] = own
            words.append(np.frombuffer(bits, "<u8"))
        return cls(PerfectHash.of(sizes, words), keys, counts)

    def find(self, keys: np.ndarray, shards: int) -> np.ndarray:
        """Each key's number; -1 for keys that are not in the table."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        own = shard_of(keys, shards)
        inside = own < len(self.hashes.size)
        number = np.where(inside, self.hashes.numbers(keys, np.where(inside, own, 0)), -1)
        return np.where(self.keys[number] == keys, number, -1)


def hashed(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, sizes, bits): a perfect hash of each shard of keys (key: distinct bigints); keys in the order of their numbers."""

    def build(table: pa.Table) -> pa.Table:
        own = table.column("key").to_numpy()
        sizes, words = PerfectHash.levels(own)
        number = PerfectHash.of([sizes], [words]).numbers(own, np.zeros(len(own), np.int64))
        ordered = np.empty_like(own)
        ordered[number] = own
        return pa.table({"shard": table.column("shard").slice(0, 1).cast(pa.int64()), "keys": [ordered], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [words.tobytes()]})

    return keys.select(shard_column(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInArrow(build, "shard bigint, keys array<bigint>, sizes array<bigint>, bits binary")


def counted(partials: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """Sums of partials (part, key, n) by key: a stored table (shard, keys, counts, sizes, bits), how many shards its keys are dealt to, and how many keys there are.

    The distinct keys get a minimal perfect hash, shard by shard. A key's count is the place of a dense vector that its number
    names. Vectors are summed as a tree: parts, some square root of them together, add up their own rows of a shard, as these stream past, and send
    a vector; a shard's vectors are added then. No task holds more than a vector and a batch, and as many vectors meet in the
    second step as groups did in the first. partials should be a stored table.
    """
    keys = materialise(partials.select("key").distinct())
    n = keys.count()
    shards = max(1, -(-n // shard_keys))
    hashes = materialise(hashed(keys, shards))
    parts = partials.select("part").distinct().count()
    groups = max(1, round(parts**0.5))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (shard, group), the shard's hash first."""
        now, held, vector = None, None, None
        for batch in batches:
            shard, group, keys, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("shard", "group", "key", "n"))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (group[1:] != group[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if i == j:
                    continue
                if (shard[i], group[i]) != now:
                    if now and vector.any():
                        yield pa.RecordBatch.from_pydict({"shard": [int(now[0])], "counts": [vector]})
                    now, bits = (shard[i], group[i]), np.frombuffer(batch.column("bits")[i].as_py(), "<u8")
                    held = PerfectHash.of([batch.column("sizes")[i].as_py()], [bits])
                    vector = np.zeros(int(np.bitwise_count(bits).sum()), np.int64)
                    i += 1
                own = keys[i:j].astype(np.int64)
                np.add.at(vector, held.numbers(own, np.zeros(len(own), np.int64)), n[i:j].astype(np.int64))
        if now and vector.any():
            yield pa.RecordBatch.from_pydict({"shard": [int(now[0])], "counts": [vector]})

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector: np.ndarray | int = 0
        for batch in batches:
            counts = batch.column("counts")
            vector = vector + counts.flatten().to_numpy().reshape(len(counts), -1).sum(0)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([key[0].as_py()], pa.int64()), "counts": [vector]})

    none = [F.lit(None).cast(t).alias(c) for c, t in (("sizes", "array<bigint>"), ("bits", "binary"))]
    heads = hashes.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("n"), "sizes", "bits")
    rows = partials.select(shard_column(F.col("key"), shards).alias("shard"), (F.col("part") % groups).cast("bigint").alias("group"), F.lit(1).alias("kind"), "key", "n", *none)
    dealt = heads.unionByName(rows).repartition("shard", "group").sortWithinPartitions("shard", "group", "kind")
    vectors = dealt.mapInArrow(add, "shard bigint, counts array<bigint>")
    summed = vectors.groupBy("shard").applyInArrow(total, "shard bigint, counts array<bigint>")
    return materialise(summed.join(hashes, "shard").select("shard", "keys", "counts", "sizes", "bits")), shards, n
