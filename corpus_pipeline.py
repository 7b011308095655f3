"""A training-data pipeline over documents: language ID, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
works on all rows it is given, is written as Parquet and read again as the next one's docs. Null texts have no letter
and go in the first stage; rows that repeat id and text are one document after the second. Other columns, whatever their
names, pass through all but the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumastack.llm.exact import drop_exact
from lumastack.llm.langid import fit, language_of
from lumastack.llm.packing import pack_documents
from lumastack.llm.queries import WORD_FILE
from lumastack.llm.secrets import KINDS, find_secrets, redacted
from lumastack.llm.shared import fold, materialise
from lumastack.llm.simhash import near_groups


def rows_of(docs: DataFrame) -> DataFrame:
    """(_row: all columns, _id, _text, _hash): columns under names of our own, so that others cannot clash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"), F.md5(text).alias("_hash"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on; those without a letter are rejected. Filters are learned from docs with a language,
    one fold of three left out, and every whole text is judged."""
    filters = fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    return docs.where(language_of(F.col("text"), filters, spark)["lang_pred"] != "und")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id goes on."""
    return drop_exact(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints (as in op8: three-word shingles) links of 3 bits or fewer connect, that with the smallest
    id goes on; where that id has several texts in one group, the one with the smallest hash. Each group is decided by itself, so rows that
    share an id and have unlike texts are documents of their own."""
    rows = rows_of(docs)
    groups = near_groups(rows.select("_id", "_text", "_hash"), distance=3, size=3, id_col="_id", text_col="_text", carry=("_hash",), with_root=True)
    first = groups.where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("_hash", "_id")).alias("f"))
    first = materialise(first.select("f._id", "f._hash").distinct())
    right = first.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"))
    return rows.join(right, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left_semi").select("_row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live, held by fewer than three sources, are cut out of the texts with what names them; n_chars follows.
    No document goes. Without a column source each distinct text is its own owner."""
    rows = rows_of(docs)
    found = find_secrets(docs, owner_col="source" if "source" in docs.columns else None)
    live = F.filter("spans", lambda s: s["live"] & (s["kind"] < len(KINDS)))
    cuts = found.select(F.col("text_hash").alias("key"), live.alias("_cuts")).where(F.size("_cuts") > 0).groupBy("key").agg(F.first("_cuts").alias("_cuts"))
    cuts = materialise(cuts.select("key", F.explode("_cuts").alias("c")).select("key", "c.start", "c.end"))
    held = rows.join(cuts.select(F.col("key").alias("_hash")).distinct(), "_hash", "left_semi")
    new = materialise(redacted(held.groupBy(F.col("_hash").alias("key")).agg(F.first("_text").alias("text")), cuts))
    joined = rows.join(new.select(F.col("key").alias("_key"), F.col("text").alias("_new")), F.col("_hash") == F.col("_key"), "left")
    size = F.when(F.col("_key").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast("bigint")) if "n_chars" in docs.columns else F.lit(None)
    changed = {"text": F.when(F.col("_key").isNull(), F.col("_text")).otherwise(F.col("_new")), "n_chars": size}
    return joined.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, tokenised and packed into sequences of 4,096 ids."""
    return pack_documents(docs, public_tokenizers.path(WORD_FILE), 4096)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan), ("best-fit packing", best_fit_packing)]
#: Fingerprints and packing cannot be written as SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
