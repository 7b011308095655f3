"""The pipeline against a brute-force version of its stages, on messy and on empty tables; its queries are registered."""

import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lumastack.llm import queries
from tests.llm.test_text_operators import LOWER, plain_best_fit, plain_redaction, plain_simhash, plain_spans, secret_at, texts
from tests.test_queries import TABLES, same
from tests.test_queries import rows as table_rows

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_stages_on_messy_rows(spark, messy):
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts(docs)
        docs = stage(spark, docs, None)
        assert docs.columns == messy.columns, name
        after = texts(docs)
        if name == "language ID":
            assert sorted(after, key=str) == sorted([(i, t) for i, t in before if any(c.isalpha() for c in t or "")], key=str)
        elif name == "exact dedup":
            assert sorted(t.translate(LOWER) for _, t in after) == sorted({t.translate(LOWER) for _, t in before})
        elif name == "SimHash near-dedup":
            prints = [(i, plain_simhash(t)) for i, t in before]
            alone = [i for i, f in prints if not any(j != i and (f ^ g).bit_count() <= 3 for j, g in prints)]
            assert {i for i, _ in after} >= set(alone)
            assert all((f ^ g).bit_count() > 3 for i, f in prints for j, g in prints if i != j and {i, j} <= {k for k, _ in after})
    assert STAGES["best-fit packing"](spark, docs, None).count() >= docs.count()


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_nothing(spark, none, name):
    assert STAGES[name](spark, none, None).count() == 0


def test_near_duplicates_of_an_id_with_several_texts(spark):
    """Groups are decided apart: an id may have unlike texts, and its own text may be the copy in another group."""
    a, b = ("the quick brown fox jumps over a lazy dog near the river bank", "seven old sailors told stories of whales and storms last night")
    for id_a, id_b in ((5, 5), (None, None)):
        docs = spark.createDataFrame([(id_a, a), (id_b, b), (6, b.upper()), (7, b.title()), (8, "quite another text with words of its own here")], "doc_id long, text string")
        got = texts(STAGES["SimHash near-dedup"](spark, docs, None))
        kept = [t.lower() for _, t in got]
        assert sorted(kept) == sorted([a, b, "quite another text with words of its own here"])
        assert (id_a, a) in got and (6 if id_b is None else 5) in {i for i, t in got if t.lower() == b}


def brute_near(rows):
    """One row of each group of near texts: that with the smallest id, of several the text with the smallest MD5; ids may repeat."""
    import hashlib

    prints = [plain_simhash(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    return sorted(min(((rows[k][0], hashlib.md5(rows[k][1].encode()).hexdigest(), rows[k][1]) for k in range(len(rows)) if group[k] == g)) for g in set(group))


def test_near_duplicates_equal_brute_force_with_repeated_ids(spark):
    r = np.random.default_rng(8)
    base = [" ".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 40)) for _ in range(12)]
    rows = [(int(r.integers(0, 10)), t.title() if r.integers(2) else t + (" end" if r.integers(3) == 0 else "")) for t in base for _ in range(4)]
    rows = sorted(set(rows))
    got = texts(STAGES["SimHash near-dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), None))
    assert sorted(got) == sorted((i, t) for i, _, t in brute_near(rows))


def test_live_secrets_are_cut_out(spark):
    rows = [(i, f"see token=SHAREDSHARED{0} here", f"s{i}", 30) for i in range(4)] + [(8, "my password = 'Qq12345678' ok", "s1", 29), (9, None, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in STAGES["secret scans"](spark, docs, None).collect()}
    assert got[8] == ("my [SECRET]' ok", 15) and got[9] == (None, None) and got[0] == (rows[0][1], 30)


def brute_force(rows, spark):
    """The stages one after another on lists of (doc_id, text, source), without Spark but for the languages' filters; ids are distinct."""
    from lumastack.llm.secrets import KINDS

    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for i, t, s in rows:
        best[t.translate(LOWER)] = max(best.get(t.translate(LOWER), (i, t, s)), (i, t, s), key=lambda r: r[0])
    rows = list(best.values())
    prints = np.array([plain_simhash(t) for _, t, _ in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, f in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ f) <= 3).tolist():
            a, b = sorted((find(i), find(i + 1 + j)))
            root[b] = a
    first = {}
    for n, (i, _, _) in enumerate(rows):
        first[find(n)] = min(first.get(find(n), i), i)
    rows = [r for n, r in enumerate(rows) if first[find(n)] == r[0]]
    owners = {}
    for _, t, s in rows:
        for span in plain_spans(t):
            owners.setdefault(secret_at(t, *span), set()).add(s)
    mark = "[SECRET]"
    clean = {i: plain_redaction(t, [(a, b) for a, k, b in plain_spans(t) if len(owners[secret_at(t, a, k, b)]) < 3], mark) for i, t, _ in rows}
    assert len(KINDS) == 3
    return clean


def test_run(spark, sf):
    """run() against the brute-force stages: the documents that stay, the pieces of their cleaned texts, and a packing as tight as best-fit decreasing."""
    found = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    clean = brute_force([(r["doc_id"], r["text"], r["source"]) for r in docs], spark)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, t in clean.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, n, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    ends = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == plain_best_fit([w[3] for w in want], 4096)[0]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and same(table_rows(got), table_rows(want))


def test_registered(spark, sf):
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES}
    assert set(queries.QUERIES) <= set(names)
    for name in ("op1_toxicity", "op7_language_id"):
        rows = names[name](spark, sf).collect()
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
        assert all(0 <= r["score"] <= 1 for r in rows) and any(r["held_out"] for r in rows)
