"""Removal of lines that repeat across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import SPACE, ascii_lower, documents, sha256
from crosstide.session import reliable_checkpoint


def _eligible(lines: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that may be dropped: id, text hash, position and a 128-bit hash of its key."""
    return (
        lines.select("id", "th", F.posexplode("lines").alias("pos", "line"))
        .select("id", "th", "pos", F.btrim("line", F.lit(SPACE)).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "th", "pos", ascii_lower(F.col("key")).alias("key"))
        .select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Documents without lines that occur in many of them: the input columns as struct ``row``, then
    n_lines, n_dropped and kept_text.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
    Lines whose key has ``min_chars`` code points or more and occurs in ``min_docs``
    different documents or more go, except from the largest id that holds the key. Only
    hashes and positions are shuffled to find them; documents per key are counted from
    distinct (key, id) pairs that were pre-aggregated, and the whole texts move once, to
    meet the positions they lose.

    Null or empty text is one empty line. Rows that repeat an id are one document for the
    count; each row is rebuilt from its own lines. A row without an id is not counted and
    keeps its lines. An empty table returns no rows.
    """
    lines = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("th"),
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"),
    )
    eligible = _eligible(lines, min_chars)
    repeated = (
        eligible.groupBy("h1", "h2")
        .agg(F.count_distinct("id").alias("n"), F.max("id").alias("holder"))
        .filter(F.col("n") >= min_docs)
        .drop("n")
    )
    repeated = reliable_checkpoint(repeated)  # small; the join can then broadcast it or split a hot line
    drops = (
        eligible.join(repeated, ["h1", "h2"])
        .filter(F.col("id") != F.col("holder"))
        .groupBy("id", "th")
        .agg(F.collect_set("pos").alias("gone"))
    )
    n = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return lines.join(drops, ["id", "th"], "left").select(
        "row",
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce(F.col("row").getField(text_col), F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def op4_line_dedup(spark, sf_dir) -> DataFrame:
    out = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, r.holder IS NOT NULL AND k.doc_id <> r.holder AS gone
  FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
