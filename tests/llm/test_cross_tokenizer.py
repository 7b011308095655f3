"""Cross-tokenizer alignment against whole texts through both libraries, and perfect hashes and their counts against plain ones."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumastack.llm import crosstoken, perfect, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "a b", " ", "  ", " a", "a ", "a  b   c ", "\n\n a \n b\t c", "don't we'll 123 45x", "日本語 のテキスト です", "naïve café  x   y", "▁ under▁bar", "zero\x00byte  here \x00 a", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "😀 emoji😀😀 end", "é combining", "​ zero width ‍ x", "᠎ old space", "x\x1c y \x1f z", "tab\t sp \t ace", "﻿ mark", "A" * 300, "under_score __init__ == !=", "ﬁ ligature ½ Ⅳ", "\r\n line\r\n ends", "مرحبا بالعالم", "한국어 문장 입니다", "a\u0085 b", "१२३ ४५",
]


def plain(docs):
    """One row per document by the definition, no units and no arrays."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in signs)}
    bytes_a = {i: bytes(byte.get(c, 0) for c in e) for e, i in t.get_vocab().items()}
    bytes_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in range(s.get_piece_size())]
    aligned, counts = [], Counter()
    for _, text in docs:
        whole = f" {text or ''}".encode()
        a, b = (t.encode(f" {text}", add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            a, b = [], []
        ends_a, ends_b = (dict(zip(np.cumsum([len(table[i]) for i in ids]).tolist(), range(len(ids)), strict=True)) for table, ids in ((bytes_a, a), (bytes_b, b)))
        both = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a[e]], b[ends_b[e]]) for e in both]
        groups, x, y = [], 0, 0
        for e in both:
            i, j = ends_a[e] + 1, ends_b[e] + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            x, y = i, j
        aligned.append((len(a), len(b), links, ";".join(groups)))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, na, nb, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), text) for (i, _), (na, nb, links, text) in zip(docs, aligned, strict=True)], counts


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("lookup_pairs", [crosstoken.LOOKUP_PAIRS, 0])
def test_alignment(spark, messy, none, lookup_pairs):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_a": F.lit(1), "key": F.lit("x"), "_row": F.lit(2)}).repartition(3)
    want, _ = plain(docs)
    got = crosstoken.align_documents(df, A, B, digests=True, lookup_pairs=lookup_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]
    rows = got.collect()
    assert key(tuple(r[:8]) for r in rows) == key(want)
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows)
    assert {r["n_a"] for r in rows if r["doc_id"] in (3, 4, 8)} == {0} and any(w[1] == 0 and docs[k][1] for k, w in enumerate(want))
    assert crosstoken.align_documents(none, A, B, lookup_pairs=lookup_pairs).count() == 0


def test_query_equals_whole_texts(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in plain(docs)[0]]
    assert key(tuple(r) for r in queries.op13_cross_tokenizer(spark, sf).collect()) == key(want)


def test_pairs_of_the_corpus(spark, messy):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    table, _, n = crosstoken.pair_counts(messy, A, B)
    want = plain(docs)[1]
    got = {(r["key"] >> 32, r["key"] & 0xFFFFFFFF): r["n"] for r in crosstoken.listed(table).collect()}
    assert got == dict(want) and n == len(want)


def test_units_never_cut_a_token():
    r = random.Random(4)
    signs = ["a", "Zz", " ", "  ", "\n", "\t", " ", "　", ".", "'s", "1", "é", "日", "́", "😀", "\x1c", "​", "▁"]
    texts = [*ODD, *("".join(r.choices(signs, k=30)) for _ in range(300))]
    own = crosstoken.Aligner(A, B)
    t, s = own.a.library, own.b.library
    lists = crosstoken.units(pa.array(texts)).to_pylist()
    for text, units in zip(texts, lists, strict=True):
        assert "".join(units) == f" {text}" and all(u[0] == " " for u in units)
        assert [i for u in units for i in t.encode(u, add_special_tokens=False).ids] == t.encode(f" {text}", add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for u in units for i in own.b.encode_new([u])[0].tolist()] == s.encode(text)


# perfect hashes --------------------------------------------------------------------------------------------------------
def test_perfect_hash_is_minimal():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(r.integers(0, 2**62, n))
        h = perfect.PerfectHash.of(*([x] for x in perfect.PerfectHash.levels(keys)))
        assert sorted(h.numbers(keys, np.zeros(len(keys), np.int64)).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="distinct"):
        perfect.PerfectHash.levels(np.array([5, 5]))


@pytest.mark.parametrize("shard_keys", [16, 100_000])
def test_counts(spark, shard_keys):
    """Sums by key over many parts, one key in a third of all rows; others are not found."""
    r = np.random.default_rng(2)
    rows = [(int(p), 7 << 32 | 9 if i % 3 == 0 else int(k), int(n)) for i, (p, k, n) in enumerate(zip(r.integers(0, 9, 6000), r.integers(0, 2000, 6000) << 32 | 5, r.integers(1, 50, 6000), strict=True))]
    want = Counter()
    for _, k, n in rows:
        want[k] += n
    table, shards, n = perfect.counted(spark.createDataFrame(rows, "part long, key long, n long"), shard_keys)
    assert n == len(want) and shards == max(1, -(-n // shard_keys)) and table.count() <= shards
    found = perfect.Counts.of(table.toArrow())
    keys = np.array(list(want), np.int64)
    at = found.find(keys, shards)
    assert len(set(at.tolist())) == n and found.counts[at].tolist() == list(want.values())
    assert (found.find(keys + (1 << 50), shards) == -1).all()
    column = spark.createDataFrame([(int(k),) for k in keys], "k long").select("k", perfect.shard_column(F.col("k"), shards).alias("s")).collect()
    assert [x["s"] for x in column] == perfect.shard_of(np.array([x["k"] for x in column]), shards).tolist()


def test_counts_of_nothing(spark):
    table, shards, n = perfect.counted(spark.createDataFrame([], "part long, key long, n long"))
    found = perfect.Counts.of(table.toArrow())
    assert n == 0 and found.find(np.array([1, 2]), shards).tolist() == [-1, -1]
