"""Corpus pipeline: language ID, line dedup, near dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each stage's rows as Parquet to the shared checkpoint folder
and reads them again for the next, so a lost executor costs a stage at most and no plan
carries the stages before it. Null texts, empty tables and further columns pass through each
stage as its operator says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm.common import documents, is_held_out
from crosstide.llm.langid import UNKNOWN, identify_languages, language_prototypes
from crosstide.llm.lines import drop_repeated_lines
from crosstide.llm.minhash import drop_near_duplicates
from crosstide.llm.packing import pack
from crosstide.llm.secret_scan import redact, scan
from crosstide.session import checkpoint_dir


def _with_text(text: Column, changed: Column) -> Column:
    """The struct ``row`` with a new text and its length where ``changed``, as it was elsewhere."""
    row = F.col("row")
    new = row.withField("text", text).withField("n_chars", F.length(text).cast("long"))
    return F.when(changed, new).otherwise(row).alias("row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters; those without a language get the predicted one."""
    prototypes = language_prototypes(docs.filter(~is_held_out("doc_id", 4, 2)))
    out = identify_languages(docs, prototypes)
    kept = out.filter((F.col("lang_pred") != UNKNOWN) | F.col("row.text").rlike(r"\p{L}"))
    found = F.coalesce("row.lang", F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred")))
    return kept.select(F.col("row").withField("lang", found).alias("row")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them repeat; n_chars follows the text."""
    return drop_repeated_lines(docs).select(_with_text(F.col("kept_text"), F.col("n_dropped") > 0)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, and all documents without one."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    clean = redact(docs, scan(docs, path_col="source"))
    return clean.select(_with_text(F.col("clean_text"), ~F.col("clean_text").eqNullSafe(F.col("row.text")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Language prediction, MinHash, the forest and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
