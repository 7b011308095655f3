"""Shards and fill-in-middle against brute force, on messy, hot and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.llm import middle, sharding


# shards ----------------------------------------------------------------------------------------------------------------
def plain_shards(docs, shards, law, overhead=16):
    """(id, size, crc, shard, slot) by one pass over all rows in order."""
    found = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + overhead, i) for i, t in docs)
    weights = [r[2] if law == "bytes" else 1 for r in found]
    upto, slots, out = 0, Counter(), []
    for (_, crc, size, i), w in zip(found, weights, strict=True):
        shard = (2 * upto + w) * shards // (2 * sum(weights))
        upto += w
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return out


def key(rows):
    return sorted(rows, key=str)


@pytest.fixture
def many_parts(spark):
    """Small results keep all their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("law", ["bytes", "rows"])
@pytest.mark.parametrize("shards", [1, 5, 40])
def test_shards(messy, none, many_parts, law, shards):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = sharding.shard_documents(messy, shards, law)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert key(tuple(r) for r in got.collect()) == key(plain_shards(docs, shards, law))
    assert sharding.shard_documents(none, shards, law).count() == 0


def test_shards_of_a_table_with_hot_ids(spark, many_parts):
    """A third of all rows share an id, a third have none; sizes differ much."""
    docs = spark.range(30_000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, 77).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'one text' WHEN id % 1000 = 1 THEN repeat('long ', 2000) ELSE repeat('x', cast(id % 50 AS int)) END").alias("text"), F.col("id").alias("at"), F.lit(1).alias("shard"))
    got = sharding.shard_documents(docs, 16).collect()
    assert key(tuple(r) for r in got) == key(plain_shards([(r["doc_id"], r["text"]) for r in docs.collect()], 16, "bytes"))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in got)
    counts = Counter(r["shard"] for r in sharding.shard_documents(docs, 16, "rows").collect())
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    parts = sharding.ordered_rows(docs, "doc_id", "text", 16, whole_rows=False).groupBy(F.shiftright("at", sharding.ROW_BITS)).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 12_000  # the id that a third share does not decide how rows are dealt


def test_shard_law_is_checked(messy):
    with pytest.raises(KeyError):
        sharding.shard_documents(messy, 4, "moon")


def test_no_overhead_and_no_bytes(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in sharding.shard_documents(docs, 3, overhead=0).select("doc_id", "size", "shard", "slot").collect()} == {(1, 0, 0, 0), (2, 0, 0, 1)}


def test_written_shards(spark, messy, tmp_path):
    sharding.write_shards(messy, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = sharding.shard_documents(messy, 4).select("doc_id", "shard", "slot")
    assert key(tuple(r) for r in back.select("doc_id", "_shard", "_slot").collect()) == key(tuple(r) for r in want.collect())
    assert key(map(str, back.select(*messy.columns).collect())) == key(map(str, messy.collect()))
    one = spark.read.parquet(str(tmp_path / "out" / "_shard=0")).coalesce(1)
    assert [r["_slot"] for r in one.sort("_slot").collect()] == list(range(one.count()))


def test_sharding_runs_no_python(messy):
    plan = sharding.shard_documents(messy, 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# fill-in-middle --------------------------------------------------------------------------------------------------------
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD = ["", "a", "Z", "@[`{/", "abc", " ", "\n\n", "é", "日本語 text", "áb", "ab\x00cd", "x" * 100, "😀😀 ok", "1a2b3c", "zz😀zz", "ÿaÿ", "\x7fA\x7f", "don't stop", "a<b<S<P", "tail "]


def words_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(-len(data) % 8 + 8), "<u8")


def test_units_ranks_and_places_by_words():
    r = np.random.default_rng(3)
    signs = ["a", "Z", "m", "@", "[", "`", "{", " ", "\n", "\x00", "\x7f", "é", "ÿ", "߿", "日", "￿", "😀"]
    for text in [*ODD[1:], *("".join(r.choice(signs, 40)) for _ in range(200))]:
        data = text.encode()
        ends = np.cumsum([len(u.encode()) for u in UNIT.findall(text)])
        found = middle.Ranks(middle.unit_ends(words_of(data)))
        assert (found.select(np.arange(1, len(ends) + 1)) + 1).tolist() == ends.tolist()
        assert found.rank(np.arange(len(data) + 1)).tolist() == [int((ends <= k).sum()) for k in range(len(data) + 1)]


def plain_middle(i, text, seed=1, rate=90, spm=20):
    t = text or ""
    h = [int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = UNIT.findall(t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (i, len(u), "plain", None, None, t)
    if h[3] % 100 < spm:
        return (i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, messy, none):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, f"now {m} then" * 3) for i, m in enumerate(("<P>", "<S>", "<M>", "<X>", "<P", "P>"))]
    docs += [(1000 + i, "The quick fox, 12 naïve 日本 dogs! " * (i % 7)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"h1": F.lit(1), "n": F.lit("x"), "form": F.lit(None)})
    want = [plain_middle(*d) for d in docs]
    got = middle.fill_in_middle(df, digests=True).collect()
    assert key(tuple(r[:6]) for r in got) == key(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    source = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs}
    assert {(r["doc_id"], r["restored_sha256"]) for r in got} == source
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() and middle.restore(r["output"].encode(), r["form"]) for r in got if r["output"])
    assert middle.fill_in_middle(none).count() == 0 and middle.fill_in_middle(none).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_other_seeds_and_rates(messy):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for seed, rate, spm in ((7, 100, 0), (7, 100, 100), (8, 0, 50)):
        got = middle.fill_in_middle(messy, seed=seed, rate=rate, spm=spm).collect()
        assert key(tuple(r) for r in got) == key(plain_middle(*d, seed, rate, spm) for d in docs)


def test_blocks_do_not_change_results(messy, monkeypatch):
    texts = [(t or "").encode() for t in (r["text"] for r in messy.collect())]
    a, b = np.arange(len(texts)) * 7919, np.arange(len(texts)) * 104729
    whole = middle.cut_texts(texts, a, b)
    alone = [middle.cut_texts([t], a[i : i + 1], b[i : i + 1]) for i, t in enumerate(texts)]
    assert all((whole[k] == np.concatenate([x[k] for x in alone])).all() for k in range(5))
