"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumastack.llm.shared import fold

WORD_FILE = "word_bpe_49k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"
JSON_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    return score(docs, model, carry=("held_out",))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), 4096)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.secrets import KINDS, LIVE, as_text, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    numbers = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(numbers) - F.size(F.array_remove(numbers, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate((*KINDS, LIVE))]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.substrings import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    filters = fit(docs.where(~F.col("held_out")))
    return identify(docs, filters, carry=("held_out",))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.simhash import near_groups

    found = near_groups(table(spark, sf_dir, "documents"), distance=3, size=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.byte_bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, ids=False, digests=True)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.sharding import shard_documents

    found = shard_documents(table(spark, sf_dir, "documents"), 40, law="bytes")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.middle import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"), seed=1, outputs=False, digests=True)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumastack.llm.crosstoken import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(JSON_FILE), public_tokenizers.path(PIECE_FILE), groups=False, digests=True)


#: A CRC32 by half bytes: what each value of the lower four bits adds when they are shifted out.
CRC_STEPS = [functools.reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(4), i) for i in range(16)]


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_best_fit_packing, op4_nearest, op5_secrets, op6_substring_dedup, op7_language_id, op8_simhash, op9_exact_dedup, op10_byte_bpe, op11_shards, op12_fill_in_middle, op13_cross_tokenizer)}

ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""",
    "op4_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
""",
    "op5_secrets": r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS owner, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, owner, t, 0 AS kind, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS ms, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS gs, regexp_split_to_array(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps, 6 AS least FROM d
  UNION ALL SELECT doc_id, owner, t, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), 20 FROM d
  UNION ALL SELECT doc_id, owner, t, 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_split_to_array(t, '[0-9a-f]+'), 24 FROM d),
e AS (SELECT doc_id, owner, t, kind, k, ms[k] AS match, gs[k] AS secret, gaps[k] AS gap, least FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m)),
p AS (SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS stop FROM e),
b AS (SELECT doc_id, owner, kind, stop - length(match) AS start, stop, secret FROM p WHERE length(secret) >= least),
o AS (SELECT secret, count(DISTINCT owner) AS owners FROM b GROUP BY secret),
s AS (SELECT doc_id, kind, start, stop FROM b UNION ALL SELECT DISTINCT doc_id, 3, stop - length(secret), stop FROM b JOIN o USING (secret) WHERE owners < 3),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_live,
  string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans
  FROM (SELECT *, (['assign', 'access', 'hex', 'live'])[kind + 1] || ':' || start || ':' || stop AS name FROM s) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN m USING (s), range(13) r(k) WHERE first < doc_id),
each AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
    "op9_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm
""",
    "op11_shards": f"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, length(h) // 2 + 16 AS size, list_transform(list_filter(string_split(regexp_replace(h, '(.)(.)', '\\2\\1', 'g'), ''), lambda x: x <> ''), lambda x: CAST(instr('0123456789ABCDEF', x) - 1 AS BIGINT)) AS half FROM b),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), half), lambda c, x: xor(c >> 4, ({CRC_STEPS}::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295) AS text_crc32 FROM n),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
k AS (SELECT *, CAST((2 * upto - size) * 40 // (2 * total) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM k
""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""",
}
