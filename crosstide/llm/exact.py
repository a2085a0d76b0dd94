"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import SPACE_CLASS, documents, sha256
from crosstide.session import reliable_checkpoint


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, hash_all: bool = False
) -> DataFrame:
    """Groups of equal texts: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one
    space. Rows are refined in three steps, each reading only what the one before
    left over: rows that share their length; of these, rows that share the hash of
    their first ``prefix_chars`` characters; of these, rows that share the SHA-256 of
    the whole text. The counts are pre-aggregated, so a group holding most rows costs
    one row per task. ``text_sha256`` is null where no full hash was needed, unless
    ``hash_all`` asks for a digest of every row.

    Null text counts as empty. Every input row returns one row. Rows that repeat an id
    and a text are one document and share its verdict. A null id never becomes
    keep_id while the group has another one. An empty table returns no rows; other
    columns are ignored, whatever their names.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE_CLASS}+", " ")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    sized = rows.select("id", "norm", F.length("norm").alias("len"))
    lengths = sized.groupBy("len").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len")
    prefix = F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix")
    prefixes = (
        sized.groupBy("len", prefix)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(lengths, "len", "left_semi")
        .filter("n > 1")
        .select("len", "prefix", F.lit(True).alias("again"))
    )
    prefixes = reliable_checkpoint(prefixes)  # so that the join deals both sides by the whole key and can split a hot one
    again = F.coalesce(F.col("again"), F.lit(False))
    hashed = (
        sized.select("id", "norm", "len", prefix)
        .join(prefixes, ["len", "prefix"], "left")
        .select("id", again.alias("again"), F.when(F.lit(hash_all) | again, sha256(F.col("norm"))).alias("sha"))
    )
    hashed = reliable_checkpoint(hashed)
    groups = (
        hashed.filter("again")
        .groupBy("sha")
        .agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    groups = reliable_checkpoint(groups)
    keep = F.coalesce(F.col("keep"), F.col("id"))
    return hashed.join(groups, "sha", "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), hash_all=True)


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
