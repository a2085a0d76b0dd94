"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that the contracts name, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split_of(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids get null."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % parts


def is_held_out(id_col: str | Column, parts: int, fold: int) -> Column:
    """Whether a row belongs to the held-out fold; rows without an id are held out, so nothing is learned from them."""
    return F.coalesce(split_of(id_col, parts) == fold, F.lit(True))


def ascii_lower(c: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(c, upper, upper.lower())


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker process makes once and keeps from task to task, such as a vocabulary."""
    kept = sys.modules.setdefault("_crosstide_worker", types.ModuleType("_crosstide_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
