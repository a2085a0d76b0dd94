"""Scan assembly: gate, enrich and label the cross-section of one date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.operators import features as ft
from crosstide.operators.graph import unique_edges
from crosstide.operators.ranking import action_label, latest_by, regime, top_bottom, top_n, with_cross_section
from crosstide.plans.insiders import insider_annotation, insider_category, insider_summary
from crosstide.plans.signals import (
    basket_zscore,
    confirm_live,
    rs_beta_adjusted,
    rs_label,
    theme_activity_label,
    zscore_label,
)


def regime_table(spark: SparkSession, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """(parent, regime) pairs in which a validated parent's children may be acted on."""
    return spark.createDataFrame(list(rows), "parent string, regime string")


def regime_gate(scored: DataFrame, regimes: DataFrame, validated: Sequence[str]) -> DataFrame:
    """``action_label``: the action only for a validated parent in one of its tradeable regimes."""
    open_ = regimes.distinct().withColumn("_open", F.lit(True))
    return (
        scored.join(open_, ["parent", "regime"], "left")
        .withColumn("is_validated", F.col("parent").isin(*validated))
        .withColumn("is_tradeable", F.coalesce("_open", F.lit(False)))
        .drop("_open")
        .withColumn(
            "action_label",
            F.when(~F.col("is_validated"), "WAIT - unvalidated").when(F.col("is_tradeable"), F.col("action")).otherwise("WAIT"),
        )
    )


# ---- dimensions of one date ---------------------------------------------------------


def event_proximity(events: DataFrame, as_of) -> DataFrame:
    """Days to the next event, its flag text and its severity; past events give NULL days."""
    days = F.date_diff(F.col("next_event_date"), F.lit(as_of).cast("date"))
    days = F.when(days >= 0, days)
    near = days <= 14
    return events.select(
        "ticker",
        "next_event_date",
        days.alias("days"),
        F.when(days == 0, "EARNINGS TODAY")
        .when(days <= 2, "EARNINGS TOMORROW")
        .when(near, F.format_string("EARNINGS %dd", days))
        .otherwise("")
        .alias("flag"),
        F.when(days <= 2, "red").when(days <= 7, "orange").when(near, "yellow").otherwise("").alias("severity"),
    )


def short_interest_latest(short: DataFrame, high: float = 10.0) -> DataFrame:
    """Latest settlement per ticker and whether the short share of the float is high."""
    latest = latest_by(short.select("ticker", "settlement_date", "short_percent_of_float"), ["ticker"], ["settlement_date"])
    return latest.withColumn("is_high", F.col("short_percent_of_float") >= high)


def news_feed(news: DataFrame, as_of, days: int = 7, n: int = 5, ticker: str | None = None) -> DataFrame:
    """The newest ``n`` headlines per ticker of the last ``days``; same-day headlines by title."""
    rows = news.filter(F.col("published_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    if ticker:
        rows = rows.filter(F.col("ticker") == ticker)
    return top_n(rows, ["ticker"], [F.desc("published_date"), F.col("title")], n)


def dedupe_text(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """First row of each text in ``order``, compared without case.

    An aggregate with partial results: copies of a frequent text collapse before the shuffle.
    """
    first = df.groupBy(F.sha2(F.lower(text), 256).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


# ---- scans --------------------------------------------------------------------------

# fixed value: the scans report no longer streak than this
STREAK_CAP = 51


def history(bars: DataFrame, as_of) -> DataFrame:
    """All rows on or before ``as_of``: lookbacks of a one-date scan may be of any length."""
    return bars.filter(F.col("date") <= F.lit(as_of).cast("date"))


def snapshot(bars: DataFrame, as_of) -> DataFrame:
    """All scan features of each ticker's last row on or before ``as_of``."""
    feats = ft.with_streak(history(bars, as_of), cap=STREAK_CAP).select(
        "ticker",
        "date",
        F.col(ft.PRICE).alias("price"),
        ft.ret(1).alias("ret_1d"),
        ft.ret(20).alias("ret_20d"),
        ft.ratio(
            F.lag(ft.PRICE, 1).over(ft.per_ticker()) - F.lag(ft.PRICE, 21).over(ft.per_ticker()),
            F.lag(ft.PRICE, 21).over(ft.per_ticker()),
        ).alias("ret_20d_prev"),
        # at most 20 rows before the last one, whatever history there is
        ft.rvol(20, "lenient").alias("rvol"),
        ft.rvol(20, "strict").alias("rvol_strict"),
        ft.rvol_trend().alias("rvol_trend"),
        ft.above_ma(50).alias("above_50ma"),
        ft.range_pct(20).alias("price_range_pct"),
        F.col("days_above").alias("days_above_50ma"),
    )
    return latest_by(feats, ["ticker"], ["date"])


def _arrow(now, before, band: float = 0.01):
    return (
        F.when(now.isNull() | before.isNull(), "—")
        .when(now > before + band, "↑")
        .when(now < before - band, "↓")
        .otherwise("→")
    )


def newest_estimate(estimates: DataFrame) -> DataFrame:
    """Latest revision score per ticker, with no date bound by design."""
    return latest_by(estimates.select("ticker", "date", "revision_score"), ["ticker"], ["date"]).select(
        "ticker", F.col("revision_score").alias("est_rev")
    )


def _enriched(rows: DataFrame, trades: DataFrame, estimates: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Left join the dimensions of a scan: insiders, estimates and events."""
    ins = insider_summary(trades, as_of).select(
        "ticker", "buy_count", "distinct_insiders", "has_cluster_buy", "has_officer_buys", "has_notable_selling", "total_dollar_value"
    )
    near = event_proximity(events, as_of).select("ticker", F.col("days").alias("earnings_days"))
    return rows.join(ins, "ticker", "left").join(newest_estimate(estimates), "ticker", "left").join(near, "ticker", "left")


def scored_pairs(bars: DataFrame, edges: DataFrame, as_of) -> DataFrame:
    """Every edge at ``as_of``: score, rank among all edges, action, regime of the parent and features."""
    snap = snapshot(bars, as_of)
    parent = snap.select(
        F.col("ticker").alias("parent"), F.col("ret_20d").alias("parent_20d_return"), F.col("ret_20d_prev").alias("_p_prev")
    )
    pairs = unique_edges(edges).select(F.col("child").alias("ticker"), "parent", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    rows = pairs.join(snap, "ticker").join(parent, "parent")
    rows = rows.withColumn("rs_score", (F.col("ret_20d") - F.col("parent_20d_return")) * F.col("weight")).filter(
        F.col("rs_score").isNotNull()
    )
    rows = rows.withColumn(
        "rs_trend", _arrow(F.col("ret_20d") - F.col("parent_20d_return"), F.col("ret_20d_prev") - F.col("_p_prev"))
    ).drop("_p_prev")
    rows = _rank_all(rows)
    return rows.withColumn("regime", regime(F.col("parent_20d_return"))).withColumn("action", action_label(F.col("pct_below")))


def _rank_all(rows: DataFrame) -> DataFrame:
    """Cross-section of one scan date, which is ranked across partitions."""
    return with_cross_section(rows, [], "rs_score", pooled=True)


def scan(
    bars: DataFrame,
    edges: DataFrame,
    trades: DataFrame,
    estimates: DataFrame,
    events: DataFrame,
    baskets: DataFrame,
    market: DataFrame,
    regimes: DataFrame,
    validated: Sequence[str],
    as_of,
) -> DataFrame:
    """The dependent scan of one date: top and bottom three children per parent, gated and enriched."""
    rows = scored_pairs(bars, edges, as_of)
    rows = regime_gate(rows, regimes, validated)
    rows = top_bottom(rows, ["parent"], "rs_score", 3)
    adjusted = rs_beta_adjusted(
        history(bars, as_of),
        edges.select(F.col("child").alias("ticker"), "parent").distinct(),
        history(market, as_of),
        dates=one_date(bars, as_of),
    ).select("ticker", "parent", "rs_adj")
    rows = rows.join(adjusted, ["ticker", "parent"], "left")
    z = basket_zscore(history(bars, as_of), baskets, dates=one_date(bars, as_of)).select("ticker", F.col("z").alias("z_score"))
    rows = _enriched(rows, trades, estimates, events, as_of).join(z, "ticker", "left")
    buying = F.coalesce("buy_count", F.lit(0)) > 0
    return rows.select(
        F.lit(as_of).cast("date").alias("scan_date"),
        "parent",
        F.col("regime").alias("parent_regime"),
        "parent_20d_return",
        "is_tradeable",
        "is_validated",
        F.col("side").alias("section"),
        "pos",
        "ticker",
        "price",
        "rs_score",
        "rs_adj",
        F.col("rank_desc").alias("rank"),
        F.col("n_valid").alias("total"),
        "action_label",
        "est_rev",
        "rvol",
        confirm_live(F.col("rs_score"), F.col("rvol"), F.col("est_rev"), buying, F.col("above_50ma")).alias("confirm"),
        insider_category(F.col("buy_count"), F.col("has_cluster_buy"), F.col("has_officer_buys"), F.col("has_notable_selling")).alias(
            "insider_annotation"
        ),
        F.coalesce("distinct_insiders", F.lit(0)).alias("distinct_insiders"),
        "above_50ma",
        "earnings_days",
        "rvol_trend",
        "rs_trend",
        "days_above_50ma",
        "price_range_pct",
        "z_score",
    )


def one_date(bars: DataFrame, as_of) -> DataFrame:
    """A calendar of the single date ``as_of``."""
    return bars.sparkSession.sql("SELECT CAST(:d AS DATE) AS date", args={"d": str(as_of)})


def theme_scan(
    bars: DataFrame,
    themes: DataFrame,
    baskets: DataFrame,
    trades: DataFrame,
    estimates: DataFrame,
    events: DataFrame,
    market: str,
    as_of,
    z_tickers: Sequence[str],
    rs_tickers: Sequence[str],
) -> DataFrame:
    """Theme tickers against their benchmark series at one date.

    Labels come from the basket z-score for ``z_tickers``, from strength for
    ``rs_tickers``, and are WATCH for everyone else.
    """
    snap = snapshot(bars, as_of)
    bench = snap.select(
        F.col("ticker").alias("benchmark"), F.col("ret_20d").alias("_b"), F.col("ret_20d_prev").alias("_bp")
    )
    spot = snap.filter(F.col("ticker") == market).agg(F.max("ret_20d")).scalar()
    rows = themes.join(snap, "ticker", "left").join(bench, "benchmark", "left")
    rows = rows.withColumn("rs_score", F.col("ret_20d") - F.col("_b")).withColumn(
        "rs_trend", _arrow(F.col("rs_score"), F.col("ret_20d_prev") - F.col("_bp"))
    )
    z = basket_zscore(history(bars, as_of), baskets, dates=one_date(bars, as_of)).select("ticker", F.col("z").alias("z_score"))
    rows = _enriched(rows, trades, estimates, events, as_of).join(z, "ticker", "left")
    buying = F.coalesce("buy_count", F.lit(0)) > 0
    days = F.coalesce("days_above_50ma", F.lit(0))
    label = (
        F.when(F.col("ticker").isin(*z_tickers), zscore_label(F.col("z_score"), "(z)", "WATCH"))
        .when(F.col("ticker").isin(*rs_tickers), rs_label(F.col("rs_score")))
        .otherwise("WATCH")
    )
    note = insider_annotation(F.col("buy_count"), F.col("has_cluster_buy"), F.col("has_officer_buys"), F.col("total_dollar_value"))
    return rows.select(
        F.lit(as_of).cast("date").alias("scan_date"),
        "theme",
        "ticker",
        "theme_label",
        "benchmark",
        "price",
        "rs_score",
        "rs_trend",
        F.col("rvol_strict").alias("rvol"),
        F.coalesce("rvol_trend", F.lit("—")).alias("rvol_trend"),
        confirm_live(F.col("rs_score"), F.col("rvol_strict"), F.col("est_rev"), buying, days > 0).alias("confirm"),
        days.alias("days_above_50ma"),
        "price_range_pct",
        "est_rev",
        F.nullif(note, F.lit("")).alias("insider_annotation"),
        "earnings_days",
        theme_activity_label(F.col("_b") - spot).alias("theme_active"),
        label.alias("action_label"),
        "z_score",
    )


def filings_feed(
    filings: DataFrame, universe: DataFrame, as_of, days: int = 7, scope: str = "all", ticker: str | None = None
) -> DataFrame:
    """Recent filings of a universe class: large names first, each ticker's filings newest first.

    ``universe`` has ticker and is_megacap. Every row carries its ticker's filing_count;
    rows stay rows, so a ticker with very many filings is no single value.
    """
    if scope not in ("all", "megacap", "dependent"):
        raise ValueError(f"unknown scope {scope!r}")
    names = universe
    if scope != "all":
        names = names.filter(F.col("is_megacap") == (scope == "megacap"))
    if ticker:
        names = names.filter(F.col("ticker") == ticker.upper())
    rows = filings.filter(F.col("filed_date") >= F.date_sub(F.lit(as_of).cast("date"), days)).join(names, "ticker")
    counts = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("filing_count"))
    return rows.join(counts, "ticker").orderBy(F.desc("is_megacap"), "ticker", F.desc("filed_date"), F.desc("impact"), "id")
