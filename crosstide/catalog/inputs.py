"""The library's tables derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.sources.bars import bars_from_lines

MARKET = "MARKET"
FOCUS_SECTOR = "AFRICA"
SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
VALIDATED = ["NATION_0", "NATION_1", "NATION_2"]
REGIMES = [
    ("NATION_0", "CORRECTION"),
    ("NATION_1", "CORRECTION"),
    ("NATION_1", "MILD_PULLBACK"),
    ("NATION_2", "UP"),
    ("NATION_2", "CORRECTION"),
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows spread over the partitions that the session sets for its data, before heavy per-row text is built from them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def series(spark: SparkSession, d: str, *levels: str) -> DataFrame:
    return bars_from_lines(
        table(spark, d, "lineitem"),
        table(spark, d, "supplier"),
        table(spark, d, "nation"),
        table(spark, d, "region"),
        levels or ("nation",),
    )


def bars(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d, "nation")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Each of the first five nations leads its own region and the next one."""
    n = table(spark, d, "nation")
    p = n.filter("n_nationkey < 5").select(
        F.col("n_name").alias("parent"), F.col("n_nationkey").alias("pk"), F.explode(F.array(F.col("n_regionkey"), (F.col("n_regionkey") + 1) % 5)).alias("n_regionkey"), F.col("n_regionkey").alias("own")
    )
    c = n.filter("n_nationkey >= 5").select(F.col("n_name").alias("child"), F.col("n_nationkey").alias("ck"), "n_regionkey")
    near = F.col("own") == F.col("n_regionkey")
    return p.join(c, "n_regionkey").select(
        "parent",
        "child",
        F.when(near, "region").otherwise("neighbour").alias("edge_type"),
        F.when(near, F.lit(0.5) + F.floor(F.col("ck") / 5) / F.lit(10.0))
        .otherwise(F.lit(0.3) + (F.col("ck") * 3 % 7) / F.lit(10.0))
        .alias("weight"),
        F.lit("").alias("notes"),
        (F.col("pk") * 100 + F.col("ck")).cast("long").alias("position"),
    )


def themes(spark: SparkSession, d: str) -> DataFrame:
    """Region baskets: theme, ticker, benchmark series and label."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.lower("r_name").alias("theme"),
        F.col("n_name").alias("ticker"),
        F.col("r_name").alias("benchmark"),
        F.concat(F.lit("Basket "), F.col("r_name")).alias("theme_label"),
    )


def trades(spark: SparkSession, d: str) -> DataFrame:
    """Insider-style trades: one per order, ticker = the customer's nation."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    day = F.to_date("o_orderdate")
    code = F.when(F.col("o_orderstatus") == "F", "P").when(F.col("o_orderstatus") == "O", "S").otherwise("A")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").cast("string").alias("accession_number"),
            F.lit(0).alias("transaction_seq"),
            F.col("n_name").alias("ticker"),
            F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).alias("filed_date"),
            day.alias("transaction_date"),
            F.col("c_name").alias("insider_name"),
            F.col("c_mktsegment").alias("insider_title"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_officer"),
            (F.col("o_orderpriority") == "2-HIGH").alias("is_director"),
            F.lit(False).alias("is_ten_percent_owner"),
            code.alias("transaction_code"),
            F.col("o_totalprice").alias("total_value"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority") != "5-LOW").alias("is_open_market"),
        )
    )


def event_trades(spark: SparkSession, d: str) -> DataFrame:
    """Dense trades of one month: one per event, ticker = the user."""
    e = table(spark, d, "events")
    filed = F.to_date("ts")
    return e.select(
        F.col("event_id").cast("string").alias("accession_number"),
        F.lit(0).alias("transaction_seq"),
        F.col("user_id").cast("string").alias("ticker"),
        filed.alias("filed_date"),
        F.date_sub(filed, (F.col("event_id") % 5).cast("int")).alias("transaction_date"),
        F.col("props").alias("insider_name"),
        F.col("event_type").alias("insider_title"),
        (F.col("value") > 20).alias("is_officer"),
        F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "error", "S").otherwise("A").alias("transaction_code"),
        F.col("value").alias("total_value"),
        F.when(F.col("event_type") == "purchase", F.lit(True)).alias("is_open_market"),
    )


def estimates(spark: SparkSession, d: str) -> DataFrame:
    """Analyst-style snapshots per nation and order day: raw up and down counts."""
    return (
        trades(spark, d)
        .groupBy("ticker", F.col("transaction_date").alias("date"))
        .agg(
            F.count(F.when(F.col("transaction_code") == "P", 1)).alias("analysts_up"),
            F.count(F.when(F.col("transaction_code") == "S", 1)).alias("analysts_down"),
        )
    )
