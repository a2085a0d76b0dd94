"""Journal: capture, snapshots, performance, notes and divergence history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.operators import features as ft
from crosstide.operators.asof import asof_forward, asof_join
from crosstide.operators.ranking import latest_by, running_total
from crosstide.sources.tables import upsert

JOURNAL_KEYS = ["scan_date", "ticker", "parent"]


def journal_rows(scan: DataFrame) -> DataFrame:
    """Journal rows of a scan, with a note where several insiders bought."""
    note = F.when(
        F.col("insider_annotation") == "cluster",
        F.format_string(
            "%d insiders bought %s in last 30d; not actionable until %s pulls back.", "distinct_insiders", "ticker", "parent"
        ),
    ).otherwise("")
    return scan.select(
        *JOURNAL_KEYS,
        "parent_regime",
        "price",
        "rs_score",
        F.format_string("(%d/%d)", "rank", "total").alias("rank"),
        "action_label",
        "est_rev",
        "rvol",
        "confirm",
        "insider_annotation",
        "earnings_days",
        "parent_20d_return",
        note.alias("notes"),
    )


def capture_journal(scan: DataFrame, journal: DataFrame, force: bool = False) -> DataFrame:
    """Journal with the scan's rows; a date already captured is left alone unless ``force``."""
    rows = journal_rows(scan)
    if not force:
        rows = rows.join(journal.select("scan_date").distinct(), "scan_date", "left_anti")
    return upsert(journal, rows, JOURNAL_KEYS)


def persist_scan(scan: DataFrame, version: int = 1) -> DataFrame:
    """One JSON document per scan date (the report of a date, a few rows per parent)."""
    payload = [c for c in scan.columns if c != "scan_date"]
    return scan.groupBy("scan_date").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("parent", "pos", *[c for c in payload if c not in ("parent", "pos")])))).alias(
            "result_json"
        ),
        F.lit(version).alias("schema_version"),
    )


def read_scan(stored: DataFrame, schema: str, version: int = 1) -> DataFrame:
    """Rows of persisted documents; documents of another schema version are ignored."""
    rows = stored.filter(F.col("schema_version") == version).withColumn("_r", F.from_json("result_json", f"array<struct<{schema}>>"))
    return rows.select("scan_date", F.inline("_r"))


def journal_performance(journal: DataFrame, bars: DataFrame) -> DataFrame:
    """Per action label: entries, mean returns to the 5th, 10th and 20th later close, hit rate at 10.

    The base is the captured price; entries without one are left out.
    """
    rows = journal.filter(F.col("price").isNotNull()).withColumn("date", F.col("scan_date"))
    rows = asof_forward(rows, bars.select("ticker", "date", ft.PRICE), ["ticker"], "date", ft.PRICE, (5, 10, 20))
    for h in (5, 10, 20):
        rows = rows.withColumn(f"r{h}", ft.ratio(F.col(f"fwd_{h}") - F.col("price"), F.col("price")))
    return rows.groupBy(F.upper(F.coalesce("action_label", F.lit(""))).alias("action_label")).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.avg(f"r{h}").alias(f"avg_{h}d") for h in (5, 10, 20)],
        F.avg((F.col("r10") > 0).cast("double")).alias("hit_rate_10d"),
        F.count("r10").alias("n_with_returns"),
    )


def divergence_outcomes(flags: DataFrame, bars: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Flags of the last ``days`` with the percent return to the fifth later close."""
    recent = flags.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    px = bars.select("ticker", "date", ft.PRICE)
    rows = asof_join(recent, px, ["ticker"], "date", [ft.PRICE])
    rows = asof_forward(rows, px, ["ticker"], "date", ft.PRICE, (5,))
    outcome = F.when(F.col(ft.PRICE) > 0, (F.col("fwd_5") - F.col(ft.PRICE)) / F.nullif(F.col(ft.PRICE), F.lit(0.0)) * 100)
    return rows.withColumn("outcome_5d", F.round(outcome, 2)).drop(ft.PRICE, "fwd_5")


def note_rows(journal: DataFrame, notes: DataFrame, mode: str = "date") -> DataFrame:
    """One row per note of a (scan_date, ticker): scan_date, ticker, pos (from 1, in id order), id, text.

    date    notes of their own date
    latest  all notes of a ticker, under its latest scan date
    ``notes`` has id (each once), observation_date, type, primary_ticker, affected_tickers (comma
    text) and note. Places are running counts over ranges of rows, so a ticker may hold most notes.
    """
    if mode not in ("date", "latest"):
        raise ValueError(f"unknown mode {mode!r}")
    others = F.coalesce(F.transform(F.split("affected_tickers", ","), lambda t: F.trim(t)), F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(F.array("primary_ticker"), others))
    fan = notes.select(
        "id", "observation_date", F.explode(names).alias("ticker"), F.concat(F.lit("["), "type", F.lit("] "), "note").alias("text")
    ).filter(F.col("ticker") != "")
    if mode == "date":
        keyed = fan.withColumnRenamed("observation_date", "scan_date")
    else:
        latest = journal.groupBy("ticker").agg(F.max("scan_date").alias("scan_date"))
        keyed = fan.drop("observation_date").join(latest, "ticker")
    placed = running_total(keyed.filter(F.col("text").isNotNull()), ["scan_date", "ticker"], ["id"], out="pos")
    return placed.select("scan_date", "ticker", "pos", "id", "text")


def journal_note_rows(journal: DataFrame, notes: DataFrame, mode: str = "date") -> DataFrame:
    """Journal rows with their notes, one row per (journal row, note): the row's keys, pos, id and text."""
    return journal.select(*JOURNAL_KEYS).join(note_rows(journal, notes, mode), ["scan_date", "ticker"])


def annotate_journal(journal: DataFrame, notes: DataFrame, mode: str = "date") -> DataFrame:
    """Append notes to journal rows of their primary and affected tickers, joined by a pipe.

    Modes as in :func:`note_rows`. All notes of one ticker and date form one text, the value being built: ask for
    few rows of a journal, or for :func:`journal_note_rows`, where a ticker has many.
    """
    text = note_rows(journal, notes, mode).groupBy("scan_date", "ticker").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " | ").alias("_add")
    )
    joined = journal.join(text, ["scan_date", "ticker"], "left")
    notes_col = F.nullif(F.concat_ws(" | ", F.nullif(F.col("notes"), F.lit("")), "_add"), F.lit(""))
    return joined.withColumn("notes", F.when(F.col("_add").isNull(), F.col("notes")).otherwise(notes_col)).select(*journal.columns)


def recent_journal(journal: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` journal rows."""
    return journal.orderBy(F.desc("scan_date"), "parent", "ticker").limit(n)


def latest_entries(journal: DataFrame) -> DataFrame:
    """Each (ticker, parent)'s latest journal row."""
    return latest_by(journal, ["ticker", "parent"], ["scan_date"])
