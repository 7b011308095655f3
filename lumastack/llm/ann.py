"""Nearest neighbours by a block matrix join with int8 tiles."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, STORED_BLOCK = 1024, 4096
#: Queries whose heaps a task holds at a time.
HELD = 65_536
#: Components that are multiplied at once: 127 * 127 * 1024 < 2**24, so float32 sums of code products are exact.
EXACT = 1024


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, its largest component in 0.5..1: cosines stay as they are, and no square over- or underflows as a whole."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 codes (held in float32, see code_products), the step of each, and the norm of what is lost."""
    vectors = scaled(vectors)
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    step = np.abs(unit).max(1, keepdims=True) / 127
    code = np.rint(unit / step)
    return code.astype(np.float32), step[:, 0], np.sqrt(((unit - code * step) ** 2).sum(1))


def code_products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Products of all codes of q with all of s, exact: parts of EXACT components in float32, added in double precision."""
    return sum((q[:, k : k + EXACT] @ s[:, k : k + EXACT].T).astype(np.float64) for k in range(0, q.shape[1], EXACT))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a and b in double precision, components added one after another, so equal pairs get equal values."""
    a, b = scaled(a), scaled(b)
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / np.sqrt(aa * bb)


def tile_nearest(queries: np.ndarray, query_ids: np.ndarray, stored: np.ndarray, stored_ids: np.ndarray, k: int) -> Iterator[tuple[int, float, int]]:
    """(query id, cosine, stored id) for all pairs of a tile that may be among the k nearest.

    With unit vectors u, v, codes' values u', v' and what is lost e_u, e_v: |u.v - u'.v'| <= |e_u| + |u'| |e_v|. A pair
    survives if its upper bound reaches the k-th largest lower bound of its query in this tile, each stored id counting once
    with its best bound.
    """
    q, qs, qe = quantised(queries)
    s, ss, se = quantised(stored)
    near = code_products(q, s) * qs[:, None] * ss[None, :]
    bound = qe[:, None] + (1 + qe)[:, None] * se[None, :] + 1e-9 + 1e-15 * q.shape[1]  # the last two for rounding in double precision
    own = query_ids[:, None] == stored_ids[None, :]
    low = np.where(own, -np.inf, near - bound)
    order = np.argsort(stored_ids, kind="stable")
    _, firsts = np.unique(stored_ids[order], return_index=True)
    if len(firsts) < len(stored_ids):
        low = np.maximum.reduceat(low[:, order], firsts, axis=1)
    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(q), -np.inf)
    i, j = np.nonzero((near + bound >= floor[:, None]) & ~own)
    return zip(query_ids[i].tolist(), cosine(queries[i], stored[j]).tolist(), stored_ids[j].tolist(), strict=True)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, vector) in blocks of at most size vectors of one dimension: (dim, ids, vectors) as binary. Equal rows are one in a block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[int, bytes], None]] = {}

        def full(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(dim), strict=True)
            data = {"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "vectors": [b"".join(vectors)]}
            return pa.RecordBatch.from_pydict(data, schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector"), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                block = held.setdefault(len(x), {})
                block[i, x.tobytes()] = None
                if len(block) == size:
                    yield full(len(x))
        for dim in list(held):
            yield full(dim)

    return rows.mapInArrow(blocks, "dim int, ids binary, vectors binary")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", salts: int | None = None) -> DataFrame:
    """The k nearest rows by cosine of each row for which is_query holds: (query_id, rank from 1, id, score), all other rows searched.

    A block matrix join: queries are packed into blocks of 1,024 and the rest into blocks of 4,096, every pair of blocks is
    one tile, and int8 products with error bounds leave a few pairs of each tile, whose cosines are computed in double
    precision on the original vectors. A task keeps a heap of k for each query over its tiles, and sends its heaps on when
    it comes to another block of queries with HELD heaps in hand; heaps are merged query by query. So memory does not grow
    with the queries, and a query costs k rows from each task. Blocks of queries are dealt over `salts` keys, hence no key
    gets all tiles. The result is exact in every dimension and for components of any finite size.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id.
    Rows that repeat an id are not candidates for one another; as queries they are one (its nearest over all of them). As
    candidates, an id's rows of one cosine are one and take one place, its rows of other cosines have places of their own.
    Only vectors of one dimension are compared. Ties go to the smaller id. A query without candidates gives no rows.
    """
    spark = vectors.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(vector_col).cast("array<double>")
    fit = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(fit & F.col(id_col).isNotNull())
    stored = packed(rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("vector")), STORED_BLOCK)
    asked = packed(rows.where(is_query).select(F.col(id_col).cast("bigint").alias("id"), v.alias("vector")), QUERY_BLOCK)
    salt = F.pmod(F.xxhash64("ids"), F.lit(salts))
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    tiles = asked.join(stored.withColumn("salt", salt), ["dim", "salt"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        block = None
        for batch in batches:
            for dim, ids, data, q_ids, q_data in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "vectors", "q_ids", "q_vectors")), strict=True):
                if q_ids != block and len(heaps) >= HELD:
                    yield from told(heaps)
                    heaps = {}
                block = q_ids
                shaped = [np.frombuffer(x, np.float64).reshape(-1, dim) for x in (q_data, data)]
                for q, score, i in tile_nearest(shaped[0], np.frombuffer(q_ids, np.int64), shaped[1], np.frombuffer(ids, np.int64), k):
                    keep(heaps.setdefault(q, []), (score, -i))
        yield from told(heaps)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:  # in order of queries: all but the last are whole
            for q, score, i in zip(*(batch.column(c).to_pylist() for c in ("query_id", "score", "id")), strict=True):
                keep(heaps.setdefault(q, []), (score, -i))
            last = {q: heaps.pop(q)} if batch.num_rows else {}
            yield from told(heaps)
            heaps = last
        yield from told(heaps)

    def keep(heap: list, entry: tuple[float, int]) -> None:
        if entry in heap:  # the same row met twice under a repeated id
            return
        if len(heap) < k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)

    def told(heaps: dict) -> Iterator[pa.RecordBatch]:
        found = [(q, rank, -e[1], e[0]) for q, heap in heaps.items() for rank, e in enumerate(sorted(heap, reverse=True), 1)]
        if found:
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "id", "score"])

    schema = "query_id bigint, rank int, id bigint, score double"
    found = tiles.select("dim", "ids", "vectors", "q_ids", "q_vectors").mapInArrow(search, schema)
    return found.repartition(F.col("query_id")).sortWithinPartitions("query_id").mapInArrow(merge, schema).withColumnRenamed("id", id_col)
