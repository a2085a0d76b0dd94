"""Insider-trade summaries and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators.asof import active_totals

WINDOW_DAYS = 30
CLUSTER_SIZE = 3
NOTABLE_SELLING = 500_000


def _is_buy() -> Column:
    return (F.col("transaction_code") == "P") & F.coalesce(F.col("is_open_market"), F.lit(False))


def _summary_aggs(end: Column) -> list[Column]:
    buy, sell = _is_buy(), F.col("transaction_code") == "S"
    last_buy = F.max(F.when(buy, F.col("transaction_date")))
    title = F.max_by(
        F.when(sell, F.col("insider_title")), F.when(sell & F.col("total_value").isNotNull(), F.struct("total_value", "accession_number"))
    )
    return [
        F.count(F.when(buy, 1)).alias("buy_count"),
        F.count_distinct(F.when(buy, F.col("insider_name"))).alias("distinct_insiders"),
        F.coalesce(F.sum(F.when(buy, F.col("total_value"))), F.lit(0.0)).alias("total_dollar_value"),
        F.coalesce(F.bool_or(F.when(buy, F.col("is_officer"))), F.lit(False)).alias("has_officer_buys"),
        (F.count_distinct(F.when(buy, F.col("insider_name"))) >= CLUSTER_SIZE).alias("has_cluster_buy"),
        F.max(F.when(buy, F.col("total_value"))).alias("largest_single_buy"),
        last_buy.alias("most_recent_buy_date"),
        F.date_diff(end, last_buy).alias("days_since_last_buy"),
        F.coalesce(F.sum(F.when(sell, F.col("total_value"))), F.lit(0.0)).alias("total_sell_value"),
        (F.coalesce(F.sum(F.when(sell, F.col("total_value"))), F.lit(0.0)) >= NOTABLE_SELLING).alias("has_notable_selling"),
        title.alias("top_seller_title"),
    ]


def insider_summary(trades: DataFrame, as_of, days: int = WINDOW_DAYS) -> DataFrame:
    """Buys and sales per ticker in the ``days`` ending at ``as_of`` (start exclusive).

    Tickers without any trade in the window have no row. The largest sale names the
    title; equal values are ordered by accession number.
    """
    end = F.lit(as_of).cast("date")
    inside = trades.filter((F.col("transaction_date") > F.date_sub(end, days)) & (F.col("transaction_date") <= end))
    return inside.filter(F.col("transaction_code").isin("P", "S")).groupBy("ticker").agg(*_summary_aggs(F.first(end)))


def _buyer_spans(base: DataFrame, days: int, nameless: bool) -> DataFrame:
    """Disjoint spans in which a name counts as a buyer of a ticker.

    A name's window is cut where its next purchase opens a new one, so adding spans up
    counts every name once. Buyers without a name are one buyer where ``nameless``, none elsewhere.
    """
    name = F.coalesce("insider_name", F.lit("")).alias("_name")
    bought = base.filter(_is_buy() & (F.lit(nameless) | F.col("insider_name").isNotNull())).select("ticker", name, F.col("transaction_date").alias("_from")).distinct()
    following = F.lead("_from").over(Window.partitionBy("ticker", "_name").orderBy("_from"))
    last = F.least(F.date_add("_from", days - 1), F.date_sub(following, 1))
    return bought.select("ticker", "_from", last.alias("_to"), F.lit(1).alias("distinct_insiders"))


def _windows(trades: DataFrame, days: int, nameless: bool) -> tuple[DataFrame, DataFrame]:
    """(daily totals with their window, buyer spans) of purchases and sales."""
    base = trades.filter(F.col("transaction_code").isin("P", "S") & F.col("transaction_date").isNotNull())
    buy, sell = _is_buy(), F.col("transaction_code") == "S"
    # money in whole cents: totals do not depend on the order of addition
    cents = F.round(F.col("total_value") * 100).cast("long")
    daily = (
        base.groupBy("ticker", F.col("transaction_date").alias("_from"))
        .agg(
            F.count(F.when(buy, 1)).alias("buy_count"),
            F.coalesce(F.sum(F.when(buy, cents)), F.lit(0)).alias("buy_cents"),
            F.count(F.when(buy & F.col("is_officer"), 1)).alias("officer_buys"),
            F.count(F.when(sell, 1)).alias("sell_count"),
            F.coalesce(F.sum(F.when(sell, cents)), F.lit(0)).alias("sell_cents"),
        )
        .withColumn("_to", F.date_add("_from", days - 1))
    )
    return daily, _buyer_spans(base, days, nameless)


MEASURES = ("buy_count", "buy_cents", "officer_buys", "sell_count", "sell_cents", "distinct_insiders")


def insider_activity(trades: DataFrame, days: int = WINDOW_DAYS, nameless: bool = False) -> DataFrame:
    """Counts, money and distinct buyers for every (ticker, date) with an open window.

    A window runs from the trade to ``days`` - 1 later. Purchases that are not on the
    open market open a window but count for nothing. Buyers without a name count as in
    :func:`insider_summary`, not at all, or as one with ``nameless``.
    """
    daily, spans = _windows(trades, days, nameless)
    zero = {m: F.lit(0).cast("long") for m in MEASURES}
    rows = daily.withColumn("distinct_insiders", zero["distinct_insiders"])
    names = spans.withColumns({m: z for m, z in zero.items() if m != "distinct_insiders"})
    total = active_totals(rows.unionByName(names), ["ticker"], "_from", "_to", MEASURES)
    return total.select(
        "ticker",
        "date",
        "buy_count",
        "distinct_insiders",
        (F.col("buy_cents") / F.lit(100.0)).alias("total_dollar_value"),
        (F.col("officer_buys") > 0).alias("has_officer_buys"),
        "sell_count",
        (F.col("sell_cents") / F.lit(100.0)).alias("total_sell_value"),
    )


def insider_daily_summary(trades: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """:func:`insider_summary` as of every date on which a window is open, from one pass.

    Totals and distinct buyers come from :func:`insider_activity`. The largest purchase, the latest one and the seller
    of the largest sale are maxima of what each day holds at its best, over a frame of ``days`` calendar days: at
    most as many rows as days, however many trades a ticker has.
    """
    base = trades.filter(F.col("transaction_code").isin("P", "S") & F.col("transaction_date").isNotNull())
    buy, sale = _is_buy(), (F.col("transaction_code") == "S") & F.col("total_value").isNotNull()
    day = F.col("transaction_date")
    best = base.groupBy("ticker", day.alias("date")).agg(
        F.max(F.when(buy, F.col("total_value"))).alias("_largest"),
        F.max(F.when(buy, day)).alias("_latest"),
        F.max(F.when(sale, F.struct("total_value", "accession_number", "insider_title"))).alias("_sale"),
    )
    activity = insider_activity(trades, days)
    n, sold = F.col("distinct_insiders"), F.col("total_sell_value")
    both = activity.withColumn("_asked", F.lit(True)).join(best, ["ticker", "date"], "full")
    recent = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(1 - days, 0)
    seen = both.withColumns({f"{c}_seen": F.max(c).over(recent) for c in ("_largest", "_latest", "_sale")}).filter("_asked")
    return seen.select(
        "ticker",
        "date",
        "buy_count",
        "distinct_insiders",
        "total_dollar_value",
        "has_officer_buys",
        (n >= CLUSTER_SIZE).alias("has_cluster_buy"),
        F.col("_largest_seen").alias("largest_single_buy"),
        F.col("_latest_seen").alias("most_recent_buy_date"),
        F.date_diff("date", "_latest_seen").alias("days_since_last_buy"),
        "total_sell_value",
        (sold >= NOTABLE_SELLING).alias("has_notable_selling"),
        F.col("_sale_seen.insider_title").alias("top_seller_title"),
    )


def insider_category(buys: Column, cluster: Column, officer: Column, selling: Column) -> Column:
    """One word for the activity; a ticker without a summary is 'none'."""
    none = F.coalesce(buys, F.lit(0)) == 0
    return (
        F.when(none & F.coalesce(selling, F.lit(False)), "selling")
        .when(none, "none")
        .when(cluster, "cluster")
        .when(officer, "officer")
        .otherwise("single")
    )


def money_text(c: Column) -> Column:
    """$1.2M from a million, $3K from a thousand, else NULL; ties round to even."""
    return F.when(c >= 1_000_000, F.format_string("$%.1fM", F.bround(c / 1_000_000, 1))).when(
        c >= 1_000, F.format_string("$%.0fK", F.bround(c / 1_000, 0))
    )


def insider_annotation(buys: Column, cluster: Column, officer: Column, dollars: Column) -> Column:
    """Star with the reasons for attention; empty without buying."""
    parts = F.concat_ws(", ", F.when(cluster, "cluster"), F.when(officer, "officer"), money_text(dollars))
    return F.when(F.coalesce(buys, F.lit(0)) == 0, "").when(parts == "", "★").otherwise(F.concat(F.lit("★ "), parts))


SIGNAL_LABELS = {2: "CLUSTER_BUY", 1: "BUY_SIGNAL", 0: "NEUTRAL", -1: "SELL_SIGNAL"}


def insider_score(trades: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(ticker, date, score, label) wherever a buy or sale is active: 2, 1 or -1.

    Dates without a row score 0.
    """
    n = F.col("distinct_insiders")
    score = F.when(n >= CLUSTER_SIZE, 2).when(n >= 1, 1).otherwise(-1)
    active = insider_activity(trades, days, nameless=True).filter((n > 0) | (F.col("sell_count") > 0))
    return active.select("ticker", "date", score.alias("score"), score_label(score).alias("label"))


def score_label(score: Column) -> Column:
    out = F.lit("NEUTRAL")
    for value, label in SIGNAL_LABELS.items():
        out = F.when(score == value, label).otherwise(out)
    return out


def insider_buy_days(trades: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Distinct (ticker, date) with an open-market buy known by then and at most ``days`` old.

    A buy is visible from its filing date to ``days`` after the trade.
    """
    buys = trades.filter(_is_buy()).select("ticker", "filed_date", F.date_add("transaction_date", days).alias("_to"))
    return active_totals(buys, ["ticker"], "filed_date", "_to", [])


def recent_purchases(trades: DataFrame, as_of, days: int = 30, min_value: float = 0.0, ticker: str | None = None) -> DataFrame:
    """Open-market purchases of the window, newest and largest first; optional conditions are added as given."""
    end = F.lit(as_of).cast("date")
    out = trades.filter(_is_buy() & (F.col("transaction_date") > F.date_sub(end, days)) & (F.col("transaction_date") <= end))
    if ticker:
        out = out.filter(F.col("ticker") == ticker.upper())
    if min_value > 0:
        out = out.filter(F.col("total_value") >= min_value)
    return out.orderBy(F.desc("transaction_date"), F.desc("total_value"))
