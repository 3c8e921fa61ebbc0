"""Exact de-duplication by a 128-bit content hash, with a comparison of the texts inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused


def md5_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash=md5_of) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_texts_of_hash.

    Rows are grouped by the content hash and, inside a hash group, by the text itself, so two different texts with
    one hash stay apart (n_texts_of_hash then counts over 1). Spark sums a group up on the map side, hence thousands of copies
    leave a task as one row; only the ids travel a second time, keyed by the digest.

    keep: "min" keeps the smallest id of equal texts, "max" the largest. Null text counts as empty. A null id never
    wins against an id; rows without an id are grouped like any other, and a group of only such rows has a null
    keep_id, of which every row is kept. Repeated rows with the same id and text are each returned and each counted in
    group_size. Extra columns are ignored, whatever their names. Empty input gives empty output.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", "_text", content_hash(F.col("_text")).alias("_hash"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"))
    best = F.min("_id") if keep == "min" else F.max("_id")
    groups = rows.groupBy("_hash", "_sha", "_text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Without the text: the digest names a text inside its hash group. Two texts with both digests equal would be
    # a SHA-256 collision, which must stop the job rather than merge rows.
    named = groups.groupBy("_hash", "_sha").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    named = named.withColumn("group_size", F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts share both digests")).cast("long")).otherwise(F.col("group_size"))).drop("_texts")
    per_hash = named.groupBy("_hash").agg(F.count(F.lit(1)).alias("n_texts_of_hash"))
    named = named.join(per_hash, "_hash")
    out = rows.drop("_text").join(named, ["_hash", "_sha"])
    kept = F.col("keep_id").isNull() | F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("_sha").alias("text_sha256"), "n_texts_of_hash")


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay.

    Of rows that share both id and text one stays; rows that share an id alone are judged each by its own text. Rows with a null
    id cannot be named as kept, so all of them stay.
    """
    (sha,) = unused(docs, "_sha")
    kept = exact_groups(docs, id_col=id_col, text_col=text_col, keep=keep).filter("kept").select(F.col(id_col), F.col("text_sha256").alias(sha)).filter(F.col(id_col).isNotNull())
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    # both steps need the rows dealt out by id and digest: one shuffle
    named = docs.withColumn(sha, digest).join(kept, [id_col, sha], "left_semi").dropDuplicates([id_col, sha]).select(docs.columns)
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
