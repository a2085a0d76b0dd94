"""Keyed loads: upsert, insert-or-ignore, partition replacement and the loaders built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.text import parse_day, parse_int, parse_num, parse_price
from crosstide.operators.ranking import latest_by

# ---- merge semantics ----------------------------------------------------------------


def newest(batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    return latest_by(batch, keys, order) if order else batch.dropDuplicates(list(keys))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Target with the batch's rows replacing those of the same key.

    Several batch rows of one key are reduced to the greatest ``order``. A small batch
    is broadcast by the optimizer, so the target is not shuffled. Missing columns
    become NULL on either side.
    """
    rows = newest(batch, keys, order)
    kept = target.join(rows.select(*keys), list(keys), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def insert_ignore(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Target plus the batch rows whose key it does not hold; the smallest ``order`` wins inside the batch."""
    return target.unionByName(new_rows(target, batch, keys, order), allowMissingColumns=True)


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """The batch rows an insert-or-ignore would add."""
    keys = list(keys)
    if order:
        payload = [c for c in batch.columns if c not in keys]
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("_row"))
        rows = first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])
    else:
        rows = batch.dropDuplicates(keys)
    # only the target keys that meet the batch are needed on the right side
    known = target.select(*keys).join(rows.select(*keys), keys, "left_semi")
    return rows.join(known, keys, "left_anti").select(*batch.columns)


def replace_partition(target: DataFrame, batch: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Delete-then-insert: every partition value present in the batch is replaced as a whole."""
    gone = batch.select(*cols).distinct()
    return target.join(gone, list(cols), "left_anti").unionByName(batch, allowMissingColumns=True)


def write_partitions(df: DataFrame, path: str, *cols: str) -> None:
    """The stored form of ``replace_partition``: only the partitions present in ``df`` are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store its scheme names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_touched(spark: SparkSession, path: str, batch: DataFrame, parts: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows of the stored partitions that a batch has keys in, and how many these are.

    The partition values of the batch reach the driver, as the list of all stored partitions does with any
    read; they become literals, so only the files of these partitions are listed and read.
    """
    stored = spark.read.parquet(path)
    hit = batch.select(*parts).distinct().collect()
    if len(parts) == 1:
        return stored.filter(F.col(parts[0]).isin([r[0] for r in hit])), len(hit)
    one = [reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in parts]) for r in hit]
    return stored.filter(reduce(or_, one, F.lit(False))), len(hit)


def upsert_stored(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], parts: Sequence[str], order: Sequence[str] | None = None) -> int:
    """Upsert into a table stored by ``parts``, rewriting only the partitions that the batch touches; returns their number.

    The partition columns follow from the keys, so a key never moves between partitions. They are not null. Where nothing
    is stored yet the batch becomes the table. The new files replace the old ones partition by partition when all are
    written; a run that fails before leaves the table as it was, and a repeated one gives the same table.
    """
    if not path_exists(spark, path):
        write_partitions(newest(batch, keys, order), path, *parts)
        return batch.select(*parts).distinct().count()
    stored, touched = read_touched(spark, path, batch, parts)
    if touched:
        write_partitions(upsert(stored, batch, keys, order).select(*stored.columns), path, *parts)
    return touched


# ---- ingest bookkeeping -------------------------------------------------------------


def ingest_windows(
    universe: DataFrame, bars: DataFrame, as_of, full_days: int = 730, recent_days: int = 30, force_full: bool = False
) -> DataFrame:
    """Start date per ticker: full history for tickers without bars, else the recent days."""
    have = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("_rows"))
    day = F.lit(as_of).cast("date")
    full = F.col("_rows").isNull() | F.lit(force_full)
    return universe.join(have, "ticker", "left").select(
        "ticker",
        F.when(full, F.date_sub(day, full_days)).otherwise(F.date_sub(day, recent_days)).alias("start"),
        day.alias("end"),
        F.when(full, "full").otherwise("incremental").alias("mode"),
    )


def ingest_status(universe: DataFrame, batch: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Rows written and status per ticker: error if one was reported, ok with rows, else empty."""
    counts = batch.groupBy("ticker").agg(F.count(F.lit(1)).alias("_rows"))
    out = universe.join(counts, "ticker", "left")
    if errors is None:
        out = out.withColumn("error_msg", F.lit(None).cast("string"))
    else:
        out = out.join(errors.groupBy("ticker").agg(F.first("error_msg", ignorenulls=True).alias("error_msg")), "ticker", "left")
    failed = F.col("error_msg").isNotNull()
    rows = F.when(failed, 0).otherwise(F.coalesce("_rows", F.lit(0)))
    return out.select(
        "ticker",
        rows.cast("long").alias("rows_written"),
        F.when(failed, "error").when(rows > 0, "ok").otherwise("empty").alias("status"),
        "error_msg",
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- loaders ------------------------------------------------------------------------


def revision_score(snapshots: DataFrame) -> DataFrame:
    """Add revision_score = (up - down) / (up + down); missing counts are 0, no counts give NULL."""
    up = F.coalesce(F.col("analysts_up"), F.lit(0))
    down = F.coalesce(F.col("analysts_down"), F.lit(0))
    return snapshots.withColumn(
        "revision_score", (up - down).cast("double") / F.nullif((up + down).cast("double"), F.lit(0.0))
    )


def next_event(events: DataFrame, as_of) -> DataFrame:
    """Earliest event on or after ``as_of`` per ticker."""
    return (
        events.filter(F.col("date") >= F.lit(as_of).cast("date"))
        .groupBy("ticker")
        .agg(F.min("date").alias("next_event_date"))
    )


def cik_map(listing: DataFrame) -> DataFrame:
    """Upper-case ticker to ten-digit identifier; the last listed wins."""
    rows = listing.select(F.upper("ticker").alias("ticker"), F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik"), "position")
    return latest_by(rows, ["ticker"], ["position"]).select("ticker", "cik")


def load_short(raw: DataFrame) -> DataFrame:
    """Short-interest rows with a settlement date."""
    return raw.select(
        "ticker",
        parse_day(F.col("settlement_date")).alias("settlement_date"),
        F.col("short_interest").cast("long").alias("short_interest"),
        F.col("days_to_cover").cast("double").alias("days_to_cover"),
        F.col("short_percent_of_float").cast("double").alias("short_percent_of_float"),
    ).filter(F.col("settlement_date").isNotNull() & F.col("ticker").isNotNull())


def load_news(raw: DataFrame) -> DataFrame:
    """Headlines with a date and a non-empty title."""
    return raw.select(
        "ticker",
        parse_day(F.col("published_utc")).alias("published_date"),
        F.trim("title").alias("title"),
        "sentiment",
        "article_url",
    ).filter(F.col("published_date").isNotNull() & (F.col("title") != ""))


JOURNAL_TEXT = ("parent_regime", "rank", "action_label", "insider_annotation", "notes")


def parse_journal(csv: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed journal rows of an exported sheet; rows without date, ticker or parent are dropped.

    Prices may carry dollar signs and commas, numbers a leading plus; empty text is NULL.
    ``keep`` passes further columns through.
    """
    text = {c: F.nullif(F.col(c), F.lit("")).alias(c) for c in JOURNAL_TEXT}
    return csv.select(
        F.trim("scan_date").try_cast("date").alias("scan_date"),
        F.nullif(F.trim("ticker"), F.lit("")).alias("ticker"),
        F.nullif(F.trim("parent"), F.lit("")).alias("parent"),
        text["parent_regime"],
        parse_price(F.col("price")).alias("price"),
        parse_num(F.col("rs_score")).alias("rs_score"),
        text["rank"],
        text["action_label"],
        text["insider_annotation"],
        parse_int(F.col("earnings_days")).alias("earnings_days"),
        parse_num(F.col("parent_20d_return")).alias("parent_20d_return"),
        text["notes"],
        *keep,
    ).dropna(subset=["scan_date", "ticker", "parent"])


def migrate_journal(csv: DataFrame, journal: DataFrame, order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(journal with the new rows, one row of counts inserted / skipped)."""
    keys = ["scan_date", "ticker", "parent"]
    add = new_rows(journal, parse_journal(csv, order or ()), keys, order).drop(*(order or ()))
    total = csv.agg(F.count(F.lit(1))).scalar()
    counts = add.agg(F.count(F.lit(1)).alias("inserted")).select("inserted", (total - F.col("inserted")).alias("skipped"))
    return journal.unionByName(add, allowMissingColumns=True), counts


# ---- retention ----------------------------------------------------------------------

RETENTION_DAYS = {"LOW": 30, "MEDIUM": 90, "HIGH": 365}


def _expired(as_of) -> Column:
    day = F.lit(as_of).cast("date")
    limit = F.lit(None).cast("date")
    for impact, days in RETENTION_DAYS.items():
        limit = F.when(F.col("impact") == impact, F.date_sub(day, days)).otherwise(limit)
    return F.coalesce(~F.col("saved_to_journal") & (F.col("filed_date") < limit), F.lit(False))


def retain_filings(filings: DataFrame, as_of) -> DataFrame:
    """Filings still within the retention of their impact, or saved to the journal."""
    return filings.filter(~_expired(as_of))


def retention_counts(filings: DataFrame, as_of) -> DataFrame:
    """How many rows each impact loses, and how many are protected."""
    gone = _expired(as_of)
    return filings.agg(
        *[F.count(F.when(gone & (F.col("impact") == i), 1)).alias(f"{i.lower()}_removed") for i in RETENTION_DAYS],
        F.count(F.when(F.col("saved_to_journal"), 1)).alias("protected"),
    )


def prune_older(df: DataFrame, date: str, as_of, days: int = 30) -> DataFrame:
    """Rows at most ``days`` old; rows without a date stay, as a comparison with NULL deletes nothing."""
    return df.filter(F.coalesce(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days), F.lit(True)))


def keep_newest(df: DataFrame, order: Sequence[str], n: int = 200) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def purge_without_summary(filings: DataFrame, impact: str = "HIGH") -> DataFrame:
    """Drop filings of an impact that have no summary, so that they load again."""
    return filings.filter(~((F.col("impact") == impact) & F.col("summary").isNull()) | F.col("impact").isNull())
