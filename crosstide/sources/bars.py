"""Daily bars: cleaning, vendor JSON, series derived from transaction lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume", "adj_close"]

VENDOR_SCHEMA = "results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>"


def load_bars(raw: DataFrame) -> DataFrame:
    """Project the eight bar columns, cast them, drop rows without a close; NaN counts as missing."""
    num = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("open", "high", "low", "close", "adj_close")}
    return raw.select(
        F.upper(F.trim("ticker")).alias("ticker"),
        F.to_date("date").alias("date"),
        num["open"].alias("open"),
        num["high"].alias("high"),
        num["low"].alias("low"),
        num["close"].alias("close"),
        F.col("volume").cast("long").alias("volume"),
        num["adj_close"].alias("adj_close"),
    ).dropna(subset=["ticker", "date", "close", "adj_close"])


def bars_from_json(landed: DataFrame, ticker: str = "ticker", body: str = "body") -> DataFrame:
    """Bars from landed vendor responses: one JSON document per row with a results array.

    Times are epoch milliseconds, read as UTC dates. Adjusted close equals close.
    """
    parsed = landed.select(F.col(ticker).alias("ticker"), F.from_json(body, VENDOR_SCHEMA).alias("r"))
    rows = parsed.select("ticker", F.inline("r.results"))
    return load_bars(
        rows.select(
            "ticker",
            F.to_date(F.timestamp_millis("t")).alias("date"),
            F.col("o").alias("open"),
            F.col("h").alias("high"),
            F.col("l").alias("low"),
            F.col("c").alias("close"),
            F.col("v").alias("volume"),
            F.col("c").alias("adj_close"),
        )
    )


def bars_from_lines(
    lines: DataFrame,
    suppliers: DataFrame,
    nations: DataFrame,
    regions: DataFrame,
    levels: tuple[str, ...] = ("nation",),
) -> DataFrame:
    """Unit-price bars of transaction lines at several levels of one hierarchy.

    nation, region  one series per name
    member          one series per region and line status, named REGION-S
    market          one series MARKET over everything
    supplier        one series per supplier key
    Prices are ratios of integer sums, so results do not depend on the order of addition.
    Lines are pre-aggregated per supplier nation before the levels are expanded: only
    (name, day) totals are shuffled for the levels.
    """
    priced = lines.select(
        "l_suppkey",
        "l_linestatus",
        F.to_date("l_shipdate").alias("date"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("qty"),
    )
    if levels == ("supplier",):
        sums = priced.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), "date").agg(
            F.sum("cents").alias("cents"), F.sum("qty").alias("qty")
        )
        return _priced(sums)
    places = suppliers.select("s_suppkey", "s_nationkey").join(
        nations.select("n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    if set(levels) - {"nation"}:
        places = places.join(regions.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        group = ["n_name", "r_name", "l_linestatus", "date"]
    else:
        group = ["n_name", "date"]
    base = priced.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(*group).agg(
        F.sum("cents").alias("cents"), F.sum("qty").alias("qty")
    )
    if group == ["n_name", "date"]:
        return _priced(base.withColumnRenamed("n_name", "ticker"))
    name = {
        "nation": F.col("n_name"),
        "region": F.col("r_name"),
        "member": F.concat_ws("-", "r_name", "l_linestatus"),
        "market": F.lit("MARKET"),
    }
    sums = (
        base.withColumn("ticker", F.explode(F.array(*[name[lv] for lv in levels])))
        .groupBy("ticker", "date")
        .agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"))
    )
    return _priced(sums)


def _priced(sums: DataFrame) -> DataFrame:
    price = F.col("cents").cast("double") / 100.0 / F.nullif(F.col("qty").cast("double"), F.lit(0.0))
    return sums.select(
        "ticker",
        "date",
        price.alias("open"),
        price.alias("high"),
        price.alias("low"),
        price.alias("close"),
        F.col("qty").alias("volume"),
        price.alias("adj_close"),
    )
