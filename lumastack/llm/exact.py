"""Exact duplicates: groups of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.llm.shared import lower_ascii, materialise


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256 (of the text with A-Z lower-cased).

    Texts are grouped by a 128-bit hash of their normal form and by the normal form itself, so the bytes of texts with one
    hash are compared and a collision splits the group. Counts and the kept id (`smallest` or `largest`) are combined
    before the shuffle: a text that a third of all rows share is one row from each task. The group table is then joined
    back by hash; its rows are a few numbers, and Spark splits a large key of that join by itself.

    A null text counts as empty. Null ids never are the kept one, unless a group has no other id: then keep_id is null and
    all its rows are kept. Rows that repeat both id and text are the same document and are kept together. Other columns
    play no part.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    groups = rows.select("id", F.md5("norm").alias("hash"), "norm").groupBy("hash", "norm").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialise(groups.select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"))
    keys = rows.select("id", F.md5("norm").alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return keys.join(groups, ["hash", "sha"]).select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts (as in exact_groups), all columns as they were.

    A single aggregation by hash and normal form keeps the row with the best id; tasks combine their own copies first, so
    a text that a third of all rows share is one row from each task. Null ids stay only where a group has no other. Of
    rows that repeat both id and text one stays.
    """
    norm = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.md5(norm).alias("_hash"), norm.alias("_norm"))
    if keep == "largest":
        best = F.max_by("_row", F.struct(F.col("_id").isNotNull(), F.col("_id")))
    else:
        best = F.min_by("_row", F.struct(F.col("_id").isNull(), F.col("_id")))
    return keyed.groupBy("_hash", "_norm").agg(best.alias("_row")).select("_row.*")
