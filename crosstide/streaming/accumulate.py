"""Incremental accumulation of strength rows from a stream of bars.

A step reads its batch and a stored tail, the newest rows of every series that the lookbacks need, so
what it reads is bounded by the series, not by their history. Bars and strength rows are stored by month, and a
step rewrites only the months that it touches. A batch with bars from before the tail reopens the dates
from its first one on: its rows come from the months stored since then, with as many rows before
them as the lookbacks need. After any sequence of batches the store equals the batch operator over all bars.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.operators import features as ft
from crosstide.operators.ranking import top_n
from crosstide.plans.signals import accumulate_rs
from crosstide.session import reliable_checkpoint
from crosstide.sources.tables import newest, path_exists, upsert_stored

BARS_DDL = "ticker string, date date, adj_close double"
RS_DDL = "ticker string, parent string, date date, rs_score double, rs_adj double"
WINDOW, BETA_WINDOW = 20, 60
#: Rows that a tail keeps beyond the lookbacks, so that series may lag behind each other by so many.
SLACK = 22
SERIES = ["ticker", "date"]


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("date", "yyyyMM").cast("int"))


def last_tail(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The tail that the newest micro-batch before ``before`` left."""
    if path_exists(spark, path):
        tails = spark.read.schema(f"{BARS_DDL}, batch int").parquet(path).filter(F.col("batch") < before)
        newest_batch = tails.agg(F.max("batch")).first()[0]
        if newest_batch is not None:
            return tails.filter(F.col("batch") == newest_batch).drop("batch")
    return spark.createDataFrame([], BARS_DDL)


def stored_since(spark: SparkSession, path: str, first: dt.date, rows: int) -> DataFrame:
    """Stored bars from ``first`` on and, of each series, at least ``rows`` before it, as far as there are any.

    Months are added going back, twice as many each time, until no series lacks rows or all months are read.
    """
    stored = spark.read.parquet(path)
    oldest = stored.agg(F.min("month")).first()[0]
    reach = 2 * rows
    while True:
        since = first - dt.timedelta(days=reach) if reach < (first - dt.date(1, 1, 1)).days else dt.date(1, 1, 1)
        month = since.year * 100 + since.month
        part = stored.filter(F.col("month") >= month)
        lacking = part.groupBy("ticker").agg(F.count_if(F.col("date") < F.lit(first)).alias("n")).filter(F.col("n") < rows)
        absent = stored.select("ticker").distinct().join(part.select("ticker").distinct(), "ticker", "left_anti") if month > oldest else None
        if month <= oldest or (lacking.isEmpty() and absent.isEmpty()):
            return part.select("ticker", "date", ft.PRICE)
        reach *= 2


def known_bars(spark: SparkSession, landed: DataFrame, tail: DataFrame, bars_path: str, first: dt.date, rows: int, keep: int) -> DataFrame:
    """The bars that a step works on: tail and batch, or the stored months where the tail does not reach back far enough."""
    have = tail.groupBy("ticker").agg(F.count_if(F.col("date") < F.lit(first)).alias("n"), F.count(F.lit(1)).alias("all"))
    if not have.filter((F.col("n") < rows) & (F.col("all") >= keep)).isEmpty():
        return stored_since(spark, bars_path, first, keep)
    both = tail.withColumn("_new", F.lit(0)).unionByName(landed.select("ticker", "date", ft.PRICE).withColumn("_new", F.lit(1)))
    return newest(both, SERIES, ["_new"]).drop("_new")


def accumulate_batch(
    batch: DataFrame, batch_id: int, pairs: DataFrame, market: str, bars_path: str, rs_path: str, window: int = WINDOW, beta_window: int = BETA_WINDOW, slack: int = SLACK
) -> None:
    """Land one micro-batch of bars, then store the strength rows of its dates (or of all since a late one).

    Bars go to ``bars_path``/rows and tails to ``bars_path``/tail. Of several bars of one key the largest price
    counts. A micro-batch that is run again gives the same tables.
    """
    spark = batch.sparkSession
    rows, keep = beta_window + 1, beta_window + 1 + slack
    landed = reliable_checkpoint(_with_month(newest(batch.select("ticker", "date", ft.PRICE).filter("date is not null"), SERIES, [ft.PRICE])))
    first = landed.agg(F.min("date")).first()[0]
    if first is None:
        return
    upsert_stored(spark, f"{bars_path}/rows", landed, SERIES, ["month"])
    tail = last_tail(spark, f"{bars_path}/tail", batch_id)
    known = reliable_checkpoint(known_bars(spark, landed, tail, f"{bars_path}/rows", first, rows, keep))
    own, spot = known.filter(F.col("ticker") != market), known.filter(F.col("ticker") == market)
    nothing = spark.createDataFrame([], "ticker string, parent string, date date")
    fresh = accumulate_rs(own, pairs, spot, nothing, window, beta_window).filter(F.col("date") >= F.lit(first))
    fresh = reliable_checkpoint(_with_month(fresh).withColumn("batch", F.lit(batch_id)))
    upsert_stored(spark, rs_path, fresh, ["ticker", "parent", "date"], ["month"])
    kept = top_n(known, ["ticker"], [F.desc("date")], keep).select("ticker", "date", ft.PRICE)
    # a series that this batch did not need to read keeps the tail that it has
    other = tail.join(known.select("ticker").distinct(), "ticker", "left_anti")
    kept.unionByName(other).write.mode("overwrite").parquet(f"{bars_path}/tail/batch={batch_id}")


def start_accumulation(stream: DataFrame, pairs: DataFrame, market: str, bars_path: str, rs_path: str, checkpoint: str):
    """Process everything available, one micro-batch at a time, and stop."""
    step = lambda batch, batch_id: accumulate_batch(batch, batch_id, pairs, market, bars_path, rs_path)
    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
