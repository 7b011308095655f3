"""Byte-level BPE encoding and decoding of whole documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.llm.bpe import RankCoder, rank_coder, regroup
from lumastack.llm.shared import doc_chunks, gather, intern_lists, materialise, text_blocks

#: White space that the cuts below do not look at.
OTHER_SPACE = r"[\x00\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def units(texts: pa.Array) -> pa.Array:
    """Each text cut into units, wherever white space follows anything else.

    No match of the pattern reaches over such a place, since white space stands only at the front of a match. So units are
    coded apart, and each distinct one only once. Texts with unusual white space are cut one by one.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.replace_substring_regex(texts, pattern=r"([^ \t\n\r])([ \t\n\r])", replacement="\\1\x00\\2")
    lists = pc.split_pattern(marked, "\x00")
    odd = pc.match_substring_regex(texts, OTHER_SPACE)
    if pc.any(odd).as_py():
        cut = [CUT.split(t) if o else own for t, o, own in zip(texts.to_pylist(), odd.to_pylist(), lists.to_pylist(), strict=True)]
        lists = pa.array(cut, pa.list_(pa.large_string()))
    return lists


#: Pieces that the corpus-wide table holds at most, those that most blocks have, and the bytes of the longest one: a bound on what is broadcast.
CORPUS_PIECES, LONGEST = 400_000, 64


@dataclass
class Codes:
    """The ids of pieces that many blocks of the corpus have, each merged once: places by piece, ids flat, and where each piece starts."""

    places: dict[str, int]
    ids: np.ndarray
    starts: np.ndarray

    def encode(self, coder: RankCoder, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces; those that are not in the table are merged here, together."""
        place = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        rest = np.flatnonzero(place < 0)
        ids, starts = coder.encode_pieces([pieces[i] for i in rest.tolist()])
        place[rest] = len(self.starts) - 1 + np.arange(len(rest))
        return regroup(np.concatenate((self.ids, ids)), np.concatenate((self.starts[:-1], self.starts[-1] + starts)), place, np.arange(len(pieces) + 1))


def corpus_codes(rows: DataFrame, path: str, pattern: str, most: int = CORPUS_PIECES) -> Codes:
    """The codes of the pieces in a column text that most blocks hold, two at least.

    Blocks send their distinct pieces, Spark counts blocks by piece, and the most frequent ones are dealt by hash and merged
    by one replay a task. How frequent follows from the number of pieces by power of two of their counts (a few hundred
    rows): as many powers as hold `most` pieces. These, of LONGEST bytes at most, reach the driver.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(path, pattern)
        for block in text_blocks(batches):
            known, _, _ = intern_lists(units(block.column("text")))
            pieces = pa.array(coder.cut(known.to_pylist())[0], pa.string())
            yield pa.RecordBatch.from_arrays([pieces.filter(pc.less_equal(pc.binary_length(pieces), LONGEST))], ["piece"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("piece") for b in batches]  # `most` pieces over all tasks
        if parts:
            pieces = pa.concat_arrays(parts)
            ids, starts = rank_coder(path, pattern).encode_pieces(pieces.to_pylist())
            yield pa.RecordBatch.from_arrays([pieces, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))], ["piece", "ids"])

    asked = rows.select("text").mapInArrow(ask, "piece string").groupBy("piece").agg(F.count("*").alias("n")).where("n > 1")
    asked = materialise(asked.select("piece", F.floor(F.log2("n") * 16).alias("power")))
    least, room = None, most
    for power, n in asked.groupBy("power").count().orderBy(F.desc("power")).collect():  # 16 powers for each doubling
        room -= n
        if room < 0:
            break
        least = power
    frequent = asked.where(F.col("power") >= F.lit(least)) if least is not None else asked.limit(0)
    found = frequent.select("piece").repartition("piece").mapInArrow(merged, "piece string, ids array<int>").toArrow()
    sizes = pc.list_value_length(found.column("ids")).to_numpy()
    ids = [c.flatten().to_numpy() for c in found.column("ids").chunks]
    return Codes({p: i for i, p in enumerate(found.column("piece").to_pylist())}, np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = True, digests: bool = False) -> DataFrame:
    """The token ids of every text, as array `ids`; with digests, also SHA-256 of the ids and of their decoded bytes.

    Merges are replayed by rank over an index from token pair to positions (lumastack.llm.bpe), over the pieces of the whole
    corpus first: those that most blocks of documents have are merged once and broadcast, of bounded number and size
    (corpus_codes). What is left of a block, its rare pieces, is replayed in the task that holds the block. Texts are read
    twice and never shuffled; no state is kept between blocks.

    A null text counts as empty and gives no ids; rows keep their id, null or repeated; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(corpus_codes(rows, path, pattern))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(path, pattern)
        for block in text_blocks(batches):
            known, flat, starts = intern_lists(units(block.column("text")))
            pieces, used, sizes = coder.cut(known.to_pylist())
            values, at = regroup(*held.value.encode(coder, pieces), used, sizes)
            values = values.astype("<u4")
            counts, lists, sha, plain = [], [], [], []
            for first, last in doc_chunks(starts):
                chunk = flat[starts[first] : starts[last]]
                tokens = gather(values, at, chunk)
                size = np.concatenate(([0], np.cumsum((at[1:] - at[:-1])[chunk])))[starts[first : last + 1] - starts[first]]
                for i, j in zip(size, size[1:], strict=False):
                    own = tokens[i:j]
                    counts.append(len(own))
                    if ids:
                        lists.append(own.astype(np.int32))
                    if digests:
                        sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                        plain.append(hashlib.sha256(coder.decode(own)).hexdigest())
            out = {"id": block.column("id"), "n_tokens": pa.array(counts, pa.int64())}
            out |= {"ids": pa.array(lists, pa.list_(pa.int32()))} if ids else {}
            out |= {"ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(plain, pa.string())} if digests else {}
            yield pa.RecordBatch.from_pydict(out)

    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return rows.mapInArrow(blocks, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row of ids, bytes that are not UTF-8 replaced; null ids give null."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(path, pattern)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int64)).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string())})

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(blocks, f"id {dict(rows.dtypes)['id']}, text string").withColumnRenamed("id", id_col)
