"""Alignment of two tokenizers over a corpus: groups, linked tokens and how often a pair of ids is linked."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.llm.bpe import Coder
from lumastack.llm.perfect import Counts, counted
from lumastack.llm.shared import doc_chunks, gather, intern_lists, materialise, text_blocks

#: Text that is aligned together, and pairs whose counts a task gathers before it sends them.
BLOCK_BYTES, HELD_PAIRS = 8 << 20, 1_000_000
#: Pairs whose counts are broadcast at most (17 bytes each); more are joined instead.
LOOKUP_PAIRS = 4_000_000
#: A space after a sign that is no white space of any kind: no token of either tokenizer reaches over the front of it.
CUT = r"([^\x00-\x20\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]) "


def joined(parts: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many texts as one array, and where each text starts."""
    flat = [np.fromiter(chain.from_iterable(lists), np.int32) for lists in parts]
    return np.concatenate([np.zeros(0, np.int32), *flat]), np.cumsum([0, *(n for lists in parts for n in map(len, lists))])


class JsonCoder(Coder):
    """A byte-level tokenizer file of the library `tokenizers`; the strings of special tokens are ordinary text."""

    REMEMBERED = 300_000

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # these bytes stand for themselves,
        rest = [b for b in range(256) if b not in printable]  # and the others as the characters from 256 on
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = self.library.get_vocab()
        table = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            table[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.token_bytes, self.token_starts = np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])

    def encode_new(self, texts: list[str], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        return joined([[e.ids for e in self.library.encode_batch_fast(texts[i : i + part], add_special_tokens=False)] for i in range(0, len(texts), part)])


class PieceCoder(Coder):
    """A model file of the library `sentencepiece`, which puts a space before what it codes; texts are given with that space."""

    REMEMBERED = 300_000

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        table = [bytes([int(p[1:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.token_bytes, self.token_starts = np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])
        #: A space within a piece would let tokens reach over the cuts between units.
        self.cuttable = not any(regex.search(r"[^▁]▁", p) for p in pieces)
        self.space = self.library.piece_to_id("▁")

    def encode_new(self, texts: list[str], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        # the library gives an empty text no tokens: it stands for a space alone
        return joined([[ids or [self.space] for ids in self.library.encode([t[1:] for t in texts[i : i + part]], num_threads=1)] for i in range(0, len(texts), part)])


def units(texts: pa.Array, cuttable: bool = True) -> pa.Array:
    """A space and each text, cut before each single space that follows a visible sign; null and empty texts have no unit.

    All units begin with a space. Both tokenizers end a token at each cut, so what they make of a text is what they make of
    its units, one after another. A text with a zero byte is a unit as a whole.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    if not cuttable:
        return pa.LargeListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int64()), texts)
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=CUT, replacement="\\1\x00 "), "\x00")
    odd = pc.match_substring(texts, "\x00")
    if pc.any(odd).as_py():
        lists = pa.array([[t] if o else own for t, o, own in zip(texts.to_pylist(), odd.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.large_string()))
    return lists


@dataclass
class Aligned:
    """A block of texts over its distinct units. valid: units that both tokenizers give back byte by byte. Of each unit: tokens of either
    kind, links (there are as many groups), and the groups as text, each with a `;` after it. pairs: a << 32 | b of all links, unit by unit."""

    flat: np.ndarray
    starts: np.ndarray
    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    link_starts: np.ndarray
    pairs: np.ndarray
    text: np.ndarray
    text_starts: np.ndarray

    @property
    def good(self) -> np.ndarray:
        """Texts all of whose units are valid; the others have no tokens."""
        bad = np.concatenate(([0], np.cumsum(~self.valid[self.flat])))
        return bad[self.starts[1:]] == bad[self.starts[:-1]]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs and how many links hold each, over all good texts."""
        owner = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        times = np.bincount(self.flat[self.good[owner]], minlength=len(self.valid))
        n = np.repeat(times, np.diff(self.link_starts))
        keys, at = np.unique(self.pairs[n > 0], return_inverse=True)
        return keys, np.bincount(at, weights=n[n > 0], minlength=len(keys)).astype(np.int64)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = JsonCoder(path_a), PieceCoder(path_b)
        ids = range(max(len(self.a.token_starts), len(self.b.token_starts)))
        marked = [f"{i}{sign}".encode() for i in ids for sign in ",|;"]
        self.numbers, self.number_starts = np.frombuffer(b"".join(marked), np.uint8), np.cumsum([0, *map(len, marked)])

    def align(self, texts: pa.Array) -> Aligned:
        known, flat, starts = intern_lists(units(texts, self.b.cuttable))
        words = known.to_pylist()
        coded = [(coder, *coder.encode(words)) for coder in (self.a, self.b)]
        size = pc.binary_length(known).to_numpy(zero_copy_only=False).astype(np.int64)
        data, at = np.frombuffer("".join(words).encode(), np.uint8), np.concatenate(([0], np.cumsum(size)))
        valid = np.ones(len(words), bool)
        lengths = [np.diff(coder.token_starts)[ids] for coder, ids, _ in coded]
        for (_, _, s), n in zip(coded, lengths, strict=True):
            ends = np.concatenate(([0], np.cumsum(n)))[s]
            valid &= np.diff(ends) == size
        for coder, ids, s in coded:
            own = gather(ids, s, np.flatnonzero(valid))
            same = gather(coder.token_bytes, coder.token_starts, own) == gather(data, at, np.flatnonzero(valid))
            wrong = np.concatenate(([0], np.cumsum(~same)))[np.concatenate(([0], np.cumsum(size[valid])))]
            valid[np.flatnonzero(valid)[np.diff(wrong) > 0]] = False

        use = np.flatnonzero(valid)
        counts, ids, ends = [], [], []
        for (coder, all_ids, s), _ in zip(coded, lengths, strict=True):
            own = gather(all_ids, s, use)
            n = np.zeros(len(words), np.int64)
            n[use] = np.diff(s)[use]
            counts.append(n)
            ids.append(own.astype(np.int64))
            ends.append(np.cumsum(np.diff(coder.token_starts)[own]))
        b = np.searchsorted(ends[1], ends[0])  # the last ends meet, so b is a place
        a = np.flatnonzero(ends[1][b] == ends[0]) if len(b) else b
        b = b[a]
        owner = np.repeat(np.arange(len(words)), counts[0])
        links = np.bincount(owner[a], minlength=len(words))
        text, text_starts = self.groups(ids, a, b, np.concatenate(([0], np.cumsum(links))))
        return Aligned(flat, starts, valid, *counts, np.concatenate(([0], np.cumsum(links))), ids[0][a] << 32 | ids[1][b], text, text_starts)

    def groups(self, ids: list[np.ndarray], a: np.ndarray, b: np.ndarray, link_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all units as text. a and b are the places of the tokens that end one."""
        codes, order = [], []
        for side, (own, last) in enumerate(zip(ids, (a, b), strict=True)):
            code = own * 3
            code[last] += 1 + side
            codes.append(code)
            order.append(np.searchsorted(last, np.arange(len(own))) * 2 + side)
        codes, order = np.concatenate(codes), np.concatenate(order)
        codes = codes[np.argsort(order, kind="stable")]
        sizes = np.concatenate(([0], np.cumsum(np.diff(self.number_starts)[codes])))
        group_ends = np.concatenate(([0], np.flatnonzero(codes % 3 == 2) + 1))
        return gather(self.numbers, self.number_starts, codes), sizes[group_ends[link_starts]]


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each Python worker."""
    return Aligner(path_a, path_b)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> tuple[DataFrame, int, int]:
    """How many links corpus-wide hold each pair of ids, as from lumastack.llm.perfect.counted (key: a << 32 | b).

    Tasks send the pairs of their blocks with their counts, those of several blocks together as long as they are few.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 2
        part = TaskContext.get().partitionId()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": np.full(len(held[0]), part, np.int64), "key": held[0], "n": held[1]})

        for block in text_blocks(batches, limit=BLOCK_BYTES):
            own = aligner(path_a, path_b).align(block.column("text")).pair_counts()
            keys, at = np.unique(np.concatenate((held[0], own[0])), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, np.concatenate((held[1], own[1])))
            held = keys, n
            if len(keys) > HELD_PAIRS:
                yield batch()
                held = (np.zeros(0, np.int64),) * 2
        if len(held[0]):
            yield batch()

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return counted(materialise(texts.mapInArrow(ask, "part bigint, key bigint, n bigint")))


def listed(counts: DataFrame) -> DataFrame:
    """(key, n, best): the counts as rows; best tells the pairs that no other pair of the same b exceeds."""
    rows = counts.select(F.explode(F.arrays_zip("keys", "counts")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.counts").alias("n"))
    b = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = rows.groupBy(b).agg(F.max("n").alias("most"))  # a row for each id of B
    return rows.select("*", b).join(F.broadcast(most), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


@dataclass
class Lookup:
    """The counts of all pairs, for tasks: n_shards tells a pair's shard."""

    counts: Counts
    best: np.ndarray
    n_shards: int

    @classmethod
    def of(cls, table: pa.Table, n_shards: int) -> Lookup:
        counts = Counts.of(table)
        b = counts.keys & 0xFFFFFFFF
        most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
        np.maximum.at(most, b, counts.counts)
        return cls(counts, counts.counts == most[b], n_shards)

    def of_units(self, block: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """For each unit its links that are best, and the sum of its links' counts."""
        number = self.counts.find(block.pairs, self.n_shards)
        # a pair of a unit that only texts without tokens hold may be unknown
        n, best = (np.where(number >= 0, values[number], 0) if len(values) else np.zeros(len(number), np.int64) for values in (self.counts.counts, self.best.astype(np.int64)))
        return tuple(np.diff(np.concatenate(([0], np.cumsum(v)))[block.link_starts]) for v in (best, n))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", *, groups: bool = True, digests: bool = False, lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum; with groups their text, with digests its SHA-256.

    A (a byte-level tokenizer file) codes a space and the text, B (a model file that adds a space) the text. Bytes at which tokens of
    both end cut them into groups, `a1,a2|b1;a3|b2,b3`; the two tokens that end there are linked. count_sum adds up, over a
    document's links, how many links of all documents hold the same two ids; n_best counts the links whose pair no other pair of the
    same B id exceeds. A null or empty text, and one that either tokenizer does not give back byte by byte, has no tokens: zeros, an
    empty text of groups, and it counts nowhere.

    A first pass aligns the texts and counts pairs (pair_counts), a second aligns them again and looks the counts up. Up to
    lookup_pairs distinct pairs are broadcast with their perfect hash; beyond that a document's distinct pairs are joined to the
    counts. Each distinct unit of a block is coded and aligned once. Rows that repeat an id keep a row each; other columns play no part.
    """
    rows = rows_of(docs, id_col, text_col)
    counts, n_shards, n_pairs = pair_counts(rows, path_a, path_b)
    small = n_pairs <= lookup_pairs
    found = docs.sparkSession.sparkContext.broadcast(Lookup.of(counts.toArrow(), n_shards)) if small else None
    columns = ("n_a", "n_b", "n_links", *(("n_best", "count_sum") if small else ()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            own = aligner(path_a, path_b).align(block.column("text"))
            each = [own.n_a, own.n_b, np.diff(own.link_starts), *(found.value.of_units(own) if small else ())]
            good, sums, texts, keys, times = own.good, np.zeros((len(each), block.num_rows), np.int64), [], [], []
            for first, last in doc_chunks(own.starts):
                chunk, at = own.flat[own.starts[first] : own.starts[last]], own.starts[first : last + 1] - own.starts[first]
                for total, values in zip(sums, each, strict=True):
                    total[first:last] = np.diff(np.concatenate(([0], np.cumsum(values[chunk])))[at])
                if groups or digests:
                    data = gather(own.text, own.text_starts, chunk).tobytes()
                    cuts = np.concatenate(([0], np.cumsum(np.diff(own.text_starts)[chunk])))[at].tolist()
                    texts.extend(data[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:], strict=False))
                if not small:
                    for row, i, j in zip(range(first, last), at.tolist(), at[1:].tolist(), strict=False):
                        k, n = np.unique(gather(own.pairs, own.link_starts, chunk[i:j]) if good[row] else own.pairs[:0], return_counts=True)
                        keys.append(k)
                        times.append(n)
            sums[:, ~good] = 0
            out = {"id": block.column("id")} | dict(zip(columns, sums, strict=True))
            texts = [t if ok else b"" for t, ok in zip(texts, good.tolist(), strict=True)] if texts else texts
            if groups:
                out["groups"] = pa.array(texts, pa.binary()).cast(pa.string())
            if digests:
                out["groups_sha256"] = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())
            if not small:
                out |= {"keys": pa.array(keys, pa.list_(pa.int64())), "times": pa.array(times, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(out)

    shown = ["groups"] * groups + ["groups_sha256"] * digests
    schema = f"id {dict(rows.dtypes)['id']}, " + ", ".join([f"{c} bigint" for c in columns] + [f"{c} string" for c in shown] + ["keys array<bigint>, times array<bigint>"] * (not small))
    aligned = rows.mapInArrow(blocks, schema)
    if not small:
        aligned = with_counts(aligned, counts)
    return aligned.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", *shown)


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds n_best and count_sum from a join of each row's distinct pairs (keys, times) with the counts; rows are told apart by a number."""
    rows = materialise(aligned.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("_row", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
    held = each.join(listed(counts), "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return rows.drop("keys", "times").join(held, "_row", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
