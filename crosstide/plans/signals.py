"""Signals over all dates at once: strength, breadth, baskets, rotation, divergence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators import features as ft
from crosstide.operators.asof import asof_join
from crosstide.operators.graph import best_parent
from crosstide.operators.ranking import (
    mean_non_null,
    rank_labels,
    xs_minmax,
    xs_zscore,
)

# ---- calendars and probes -----------------------------------------------------------


def trading_dates(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def every_nth_date(bars: DataFrame, n: int = 5, offset: int = 0, drop_last: bool = False) -> DataFrame:
    """Every ``n``-th distinct trading date from position ``offset``; ``drop_last`` omits the last pick.

    The ordering runs over distinct dates only: one row per trading day.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    picked = (
        trading_dates(bars)
        .withColumn("_pos", F.row_number().over(w) - 1)
        .filter((F.col("_pos") >= offset) & ((F.col("_pos") - offset) % n == 0))
    )
    if drop_last:
        picked = picked.withColumn("_next", F.lead("date").over(w)).filter(F.col("_next").isNotNull())
    return picked.select("date")


def on_dates(keys: DataFrame, dates: DataFrame) -> DataFrame:
    """Every key on every date: the grid a rebalancing signal is asked for.

    ``dates`` is a calendar, so it travels as one array (one value per trading day)
    and is exploded next to each key; nothing is paired beyond the result itself.
    """
    days = dates.agg(F.sort_array(F.collect_set("date")).alias("d"))
    return keys.withColumn("date", F.explode(days.scalar()))


def with_parent(children: DataFrame, parent_facts: DataFrame, cols: Sequence[str], prefix: str = "p_") -> DataFrame:
    """Attach the parent's latest values at each child row's date (its own last row)."""
    facts = parent_facts.select(F.col("ticker").alias("parent"), "date", *[F.col(c).alias(prefix + c) for c in cols])
    return asof_join(children, facts, ["parent"], "date", [prefix + c for c in cols])


# ---- relative strength --------------------------------------------------------------


def edge_scores(
    bars: DataFrame,
    edges: DataFrame,
    lookback: int = 20,
    dates: DataFrame | None = None,
    normalized: bool = False,
) -> DataFrame:
    """(ticker, parent, date, score, parent_ret): return difference to the parent times edge weight.

    On the child's own dates, or on ``dates`` with both sides taken as of them.
    ``normalized`` divides by the child's realised volatility. Rows without a score are kept.
    """
    feats = bars.select("ticker", "date", ft.PRICE)
    if normalized:
        feats = ft.with_realized_vol(feats, lookback, "vol")
    else:
        feats = feats.withColumn("vol", F.lit(1.0))
    feats = feats.select("ticker", "date", ft.ret(lookback).alias("ret"), "vol")
    e = edges.select(F.col("child").alias("ticker"), "parent", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    if dates is None:
        rows = feats.join(e, "ticker")
    else:
        rows = asof_join(on_dates(e, dates), feats, ["ticker"], "date", ["ret", "vol"])
    rows = with_parent(rows, feats, ["ret"])
    raw = (F.col("ret") - F.col("p_ret")) * F.col("weight")
    return rows.select(
        "ticker", "parent", "date", ft.ratio(raw, F.col("vol")).alias("score"), F.col("p_ret").alias("parent_ret")
    )


def rs(bars: DataFrame, edges: DataFrame, lookback: int = 20, dates: DataFrame | None = None) -> DataFrame:
    """Relative strength against the parent; only defined scores."""
    return edge_scores(bars, edges, lookback, dates).filter(F.col("score").isNotNull())


def rs_normalized(bars: DataFrame, edges: DataFrame, lookback: int = 20, dates: DataFrame | None = None) -> DataFrame:
    """Relative strength per unit of the child's realised volatility."""
    return edge_scores(bars, edges, lookback, dates, normalized=True).filter(F.col("score").isNotNull())


def pair_strength(normalized: bool = False) -> Column:
    """The score of ``edge_scores`` on a row that holds ret and vol of the child, p_ret of the parent and the weight."""
    raw = (F.col("ret") - F.col("p_ret")) * F.coalesce("weight", F.lit(1.0))
    return ft.ratio(raw, F.col("vol")) if normalized else raw


# name -> callable(bars, edges, lookback, dates): the extension point for scored signals
SIGNALS: dict[str, Callable[..., DataFrame]] = {"rs": rs, "rs_normalized": rs_normalized}


def pair_signal(name: str) -> Column | None:
    """The expression of a signal over (ret, vol, p_ret, weight), None where a function of its own scores it."""
    built_in = {"rs": (rs, False), "rs_normalized": (rs_normalized, True)}.get(name)
    return pair_strength(built_in[1]) if built_in and SIGNALS.get(name) is built_in[0] else None


def register_signal(name: str, fn: Callable[..., DataFrame]) -> None:
    SIGNALS[name] = fn


def rs_trend(bars: DataFrame, edges: DataFrame, lookback: int = 20, band: float = 0.01) -> DataFrame:
    """Arrow per edge and child date: raw strength now against one row earlier on both sides."""
    feats = bars.select(
        "ticker",
        "date",
        ft.ret(lookback).alias("now"),
        ft.ratio(
            F.lag(ft.PRICE, 1).over(ft.per_ticker()) - F.lag(ft.PRICE, lookback + 1).over(ft.per_ticker()),
            F.lag(ft.PRICE, lookback + 1).over(ft.per_ticker()),
        ).alias("prev"),
    )
    rows = feats.join(edges.select(F.col("child").alias("ticker"), "parent"), "ticker")
    rows = with_parent(rows, feats, ["now", "prev"])
    today, before = F.col("now") - F.col("p_now"), F.col("prev") - F.col("p_prev")
    arrow = (
        F.when(today.isNull() | before.isNull(), "—")
        .when(today > before + band, "↑")
        .when(today < before - band, "↓")
        .otherwise("→")
    )
    return rows.select("ticker", "parent", "date", arrow.alias("rs_trend"))


def rs_beta_adjusted(
    bars: DataFrame,
    pairs: DataFrame,
    market: DataFrame,
    window: int = 20,
    beta_window: int = 60,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Return differences after removing beta times the market return on each side.

    ``pairs`` has ticker and parent; every series needs beta_window + 1 prices.
    Yields (ticker, parent, date, rs_score, rs_adj): raw and adjusted, unweighted.
    """
    cols = ["ret", "rets", "sum1", "sum2", "seen"]
    feats = ft.with_return_window(bars.select("ticker", "date", ft.PRICE), beta_window, window)
    m = ft.with_return_window(market.select(F.lit("m").alias("ticker"), "date", ft.PRICE), beta_window, window)
    p = pairs.select("ticker", "parent")
    if dates is None:
        rows = feats.join(p, "ticker")
    else:
        rows = asof_join(on_dates(p, dates), feats, ["ticker"], "date", cols)
    rows = with_parent(rows, feats, cols)
    days = rows.select("date").distinct().withColumn("ticker", F.lit("m"))
    spot = asof_join(days, m, ["ticker"], "date", cols, unique=True).select("date", *[F.col(c).alias("m_" + c) for c in cols])
    rows = rows.join(spot, "date", "left")
    # both windows end at the probe date, whatever each side's own last date is
    beta = lambda pre: ft.position_beta(pre, "m_", beta_window)
    adj = (F.col("ret") - beta("") * F.col("m_ret")) - (F.col("p_ret") - beta("p_") * F.col("m_ret"))
    return rows.select("ticker", "parent", "date", (F.col("ret") - F.col("p_ret")).alias("rs_score"), adj.alias("rs_adj"))


def accumulate_rs(bars: DataFrame, pairs: DataFrame, market: DataFrame, existing: DataFrame, window: int = 20, beta_window: int = 60) -> DataFrame:
    """New (ticker, parent, date, rs_score, rs_adj) rows on dates both sides trade and not yet stored."""
    scored = rs_beta_adjusted(bars, pairs, market, window, beta_window).filter(F.col("rs_score").isNotNull())
    parent_days = bars.select(F.col("ticker").alias("parent"), "date")
    return scored.join(parent_days, ["parent", "date"], "left_semi").join(
        existing.select("ticker", "parent", "date"), ["ticker", "parent", "date"], "left_anti"
    ).select("ticker", "parent", "date", "rs_score", "rs_adj")


def rs_vs_benchmark(bars: DataFrame, themes: DataFrame, lookback: int = 20) -> DataFrame:
    """Unweighted strength of each basket ticker against its benchmark series."""
    e = themes.select(F.col("ticker").alias("child"), F.col("benchmark").alias("parent")).distinct()
    scored = edge_scores(bars, e.withColumn("weight", F.lit(1.0)), lookback)
    return scored.select("ticker", F.col("parent").alias("benchmark"), "date", F.col("score").alias("rs_score"))


def theme_activity_label(c: Column) -> Column:
    return F.when(c.isNull(), "UNKNOWN").when(c > 0, "ACTIVE").when(c >= -0.02, "NEUTRAL").otherwise("INACTIVE")


def theme_activity(bars: DataFrame, themes: DataFrame, market: str, lookback: int = 20) -> DataFrame:
    """Activity of each benchmark series against the market series, per benchmark date."""
    pairs = themes.select(F.col("benchmark").alias("ticker")).distinct().withColumn("benchmark", F.lit(market))
    s = rs_vs_benchmark(bars, pairs, lookback)
    return s.select(F.col("ticker").alias("benchmark"), "date", theme_activity_label(F.col("rs_score")).alias("theme_active"))


# ---- baskets ------------------------------------------------------------------------


def zscore_label(c: Column, suffix: str = "", missing: str = "—") -> Column:
    return (
        F.when(c.isNull(), missing)
        .when(c > 1.5, "STRONG_BUY" + suffix)
        .when(c > 0.5, "BUY" + suffix)
        .when(c > -0.5, "HOLD" + suffix)
        .otherwise("SELL" + suffix)
    )


def rs_label(c: Column, missing: str = "WATCH") -> Column:
    return (
        F.when(c.isNull(), missing)
        .when(c >= 0.15, "STRONG_BUY")
        .when(c >= 0.05, "BUY")
        .when(c >= -0.05, "HOLD")
        .otherwise("SELL")
    )


def basket_zscore(
    bars: DataFrame, baskets: DataFrame, lookback: int = 20, dates: DataFrame | None = None, min_members: int = 3
) -> DataFrame:
    """Cross-sectional z-score of the n-row return within (basket, date).

    ``baskets`` has theme and ticker. On ``dates`` each member counts with its own
    last row; otherwise only members trading that day do. Adds rvol (lenient history
    is not enough: ``lookback`` full rows before) and z times rvol.
    """
    feats = bars.select(
        "ticker",
        "date",
        F.col(ft.PRICE).alias("price"),
        ft.ret(lookback).alias("ret"),
        F.when(ft.rows_seen() > lookback, ft.rvol(lookback, "lenient")).alias("rvol"),
    )
    members = baskets.select("theme", "ticker")
    if dates is None:
        rows = feats.join(members, "ticker")
    else:
        rows = asof_join(on_dates(members, dates), feats, ["ticker"], "date", ["price", "ret", "rvol"], fact_date="latest_date")
    z = xs_zscore(rows, ["theme", "date"], "ret", "z", min_members)
    return z.withColumn("combined", F.col("z") * F.col("rvol"))


def zscore_rvol_scan(bars: DataFrame, baskets: DataFrame, dates: DataFrame, lookback: int = 20) -> DataFrame:
    """Basket scan: z times relative volume with its label, best first within a date."""
    rows = basket_zscore(bars, baskets, lookback, dates)
    return rows.withColumn("action", zscore_label(F.col("combined"))).select(
        "theme", "date", "ticker", "price", "latest_date", F.col("ret").alias("ret_20d"), "z", "rvol", "combined", "action"
    )


def label_order(label: Column) -> Column:
    """Sort position of an action label, unknown last."""
    order = ["STRONG_BUY", "BUY", "HOLD", "SELL"]
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), label), F.lit(0)), F.lit(5))


# ---- confirmation -------------------------------------------------------------------


def _point(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)


RVOL_CONFIRMS = 1.5


def confirm_live(rs_score: Column, rvol: Column, rev: Column, insider: Column, trend: Column, kind: str = "dependent") -> Column:
    """0 to 5; ``trend`` is the above-average flag (dependent) or the 0-2 trend score (megacap)."""
    structure = trend >= 2 if kind == "megacap" else trend
    return _point(rs_score > 0) + _point(rvol >= RVOL_CONFIRMS) + _point(rev > 0) + _point(insider) + _point(structure)


def confirm_backtest(rs_positive: Column, rvol: Column, insider: Column, above: Column) -> Column:
    """0 to 4: estimate revisions are left out."""
    return _point(rs_positive) + _point(rvol >= RVOL_CONFIRMS) + _point(insider) + _point(above)


# ---- composite of large members -----------------------------------------------------

TIMEFRAMES = (20, 60, 120)


def align_ffill(bars: DataFrame, members: DataFrame, benchmarks: Sequence[str]) -> DataFrame:
    """Members on the dates all of them trade, with benchmark closes filled forward on those dates.

    ``members`` has one column ticker. Adds one column bench_<i> per benchmark.
    """
    own = bars.join(members, "ticker", "left_semi")
    n = members.select(F.count_distinct("ticker")).scalar()
    common = own.groupBy("date").agg(F.count_distinct("ticker").alias("_k")).filter(F.col("_k") == n).select("date")
    out = own.join(common, "date")
    calendar = common
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    for i, b in enumerate(benchmarks):
        name = f"bench_{i}"
        closes = bars.filter(F.col("ticker") == b).select("date", F.col(ft.PRICE).alias(name))
        # one row per trading day, so a single ordered pass over the calendar is bounded
        filled = common.join(closes, "date", "left").select("date", F.last(name, ignorenulls=True).over(w).alias(name))
        calendar = calendar.join(filled, "date", "left")
    return out.join(calendar, "date")


def megacap_composite(
    aligned: DataFrame,
    n_benchmarks: int = 2,
    history: int = 252,
    label_mode: str = "live",
    warmup: int = 0,
    min_valid: int = 1,
    timeframes: Sequence[int] = TIMEFRAMES,
) -> DataFrame:
    """Strength against each benchmark over several horizons, own-history percentile, trend and volume.

    Works on ``align_ffill`` output. Cross-section statistics are per date.
    ``warmup`` drops each series' first rows, ``min_valid`` dates with fewer members.
    """
    df = ft.with_vol_conviction(aligned)
    for tf in timeframes:
        df = ft.with_hist_pct(df, tf, history)
    trend = ft.trend_score()
    diffs = []
    for tf in timeframes:
        for b in range(n_benchmarks):
            name = f"rs_{b}_{tf}"
            df = df.withColumn(name, ft.ret(tf) - ft.ret(tf, f"bench_{b}"))
            diffs.append(name)
    df = df.withColumn("trend_raw", trend).withColumn("trend", F.col("trend_raw") / F.lit(2.0))
    df = df.withColumn("rvol", ft.rvol(20, "megacap")).withColumn("_pos", ft.rows_seen())
    df = df.filter(F.col("_pos") > warmup)
    sizes = df.groupBy("date").agg(F.count(F.lit(1)).alias("_members"))
    df = df.join(sizes, "date").filter(F.col("_members") >= min_valid).drop("_members")
    df = xs_minmax(df, ["date"], diffs)
    per_tf = []
    for tf in timeframes:
        parts = [F.col(f"norm_rs_{b}_{tf}") for b in range(n_benchmarks)] + [F.col(f"hist_pct_{tf}")]
        df = df.withColumn(f"composite_rs_{tf}", mean_non_null(*parts))
        per_tf.append(F.col(f"composite_rs_{tf}"))
    df = df.withColumn("composite_rs", mean_non_null(*per_tf))
    df = df.withColumn("composite", mean_non_null(F.col("composite_rs"), F.col("trend"), F.col("vol_conviction")))
    df = df.withColumn("iso_rs_multi", mean_non_null(*[F.col(c) for c in diffs]))
    df = df.withColumn("iso_hist_pct", mean_non_null(*[F.col(f"hist_pct_{tf}") for tf in timeframes]))
    return rank_labels(df, ["date"], "composite", label_mode).drop("_pos")


# ---- rotation -----------------------------------------------------------------------


def rotation_status(rank: Column) -> Column:
    return F.when(rank <= 2, "LEADING").when(rank == 3, "NEUTRAL").otherwise("LAGGING")


def sector_rotation(
    bars: DataFrame,
    sectors: Sequence[str],
    focus: str,
    market: str,
    dates: DataFrame,
    min_rows: int = 65,
) -> DataFrame:
    """Rank of the focus sector by the mean of its 20- and 60-row returns, one row per date.

    A sector without composite ranks last; ties keep the order of ``sectors``.
    ``data_available`` tells whether all sectors have ``min_rows`` of history.
    """
    feats = bars.filter(F.col("ticker").isin(*sectors, market)).select(
        "ticker", "date", ft.ret(20).alias("r20"), ft.ret(60).alias("r60"), ft.rows_seen().alias("seen")
    )
    names = feats.sparkSession.createDataFrame(
        [(s, i) for i, s in enumerate([*sectors, market])], "ticker string, pos int"
    )
    rows = asof_join(on_dates(names, dates), feats, ["ticker"], "date", ["r20", "r60", "seen"])
    rows = rows.withColumn("composite", mean_non_null(F.col("r20"), F.col("r60")))
    is_sector = F.col("pos") < len(sectors)
    w = Window.partitionBy("date", is_sector).orderBy(F.desc_nulls_last("composite"), "pos")
    rows = rows.withColumn(
        "rank", F.when(F.col("composite").isNull(), len(sectors)).otherwise(F.row_number().over(w))
    )
    at = lambda t, c: F.max(F.when(F.col("ticker") == t, F.col(c)))
    return (
        rows.groupBy("date")
        .agg(
            at(focus, "rank").cast("long").alias("focus_rank"),
            at(focus, "r20").alias("focus_20d"),
            at(focus, "r60").alias("focus_60d"),
            at(market, "r20").alias("market_20d"),
            (F.count(F.when(is_sector & (F.col("seen") >= min_rows), 1)) == len(sectors)).alias("data_available"),
        )
        .withColumn("focus_status", rotation_status(F.col("focus_rank")))
        .withColumn("focus_vs_market", F.col("focus_20d") - F.col("market_20d"))
    )


def vol_level_label(level: Column) -> Column:
    """Label of a volatility index level."""
    return (
        F.when(level.isNull(), "").when(level < 15, "LOW").when(level < 20, "CALM").when(level < 30, "ELEVATED").otherwise("FEAR")
    )


# ---- divergence ---------------------------------------------------------------------


def divergence_strength(t: Column, m: Column, b: Column, from_theme: Column) -> Column:
    """How a ticker's one-day return diverges from market and benchmark; NULL if it does not.

    After a market gain above 1 % the test is relative to the market. The MODERATE
    level needs more than STRONG and is tested after it, so it never shows.
    """
    vs_m, vs_b = t - m, t - b
    adaptive = m > 0.01
    base = F.when(adaptive, vs_m >= 0.03).otherwise((t >= 0.02) & (m <= 0.0))
    return (
        F.when(from_theme & (t >= 0.05) & (b != 0) & (t >= b * 3), "SECTOR_OUTPERFORM")
        .when(base & (vs_b >= 0.02), "STRONG")
        .when(base & (vs_b >= 0.03), "MODERATE")
        .when((t >= 0.03) & (b <= -0.01), "BENCHMARK")
    )


def divergences(
    bars: DataFrame,
    edges: DataFrame,
    themes: DataFrame,
    market: str,
    dates: DataFrame,
    source: str = "all",
    n: int = 7,
) -> DataFrame:
    """The ``n`` strongest divergences per date.

    Graph tickers are measured against their highest-weight parent, theme tickers that
    are not in the graph against their benchmark. Returns in percent, two digits.
    """
    if source not in ("all", "dependency", "theme"):
        raise ValueError(f"unknown source {source!r}")
    one_day = bars.select("ticker", "date", ft.ret(1).alias("r1"))
    theme_of = themes.groupBy("ticker").agg(F.max_by(F.struct("benchmark", "theme_label"), "theme").alias("t"))
    dep = best_parent(edges).select(F.col("child").alias("ticker"), F.col("parent").alias("benchmark"), "parent")
    dep_rows = dep.join(theme_of.select("ticker", F.col("t.theme_label").alias("theme")), "ticker", "left").withColumn(
        "source", F.lit("dependency")
    )
    theme_rows = theme_of.select(
        "ticker", "t.benchmark", F.lit(None).cast("string").alias("parent"), F.col("t.theme_label").alias("theme"), F.lit("theme").alias("source")
    )
    if source == "all":
        theme_rows = theme_rows.join(dep.select("ticker"), "ticker", "left_anti")
    wanted = {
        "all": dep_rows.unionByName(theme_rows),
        "dependency": dep_rows,
        "theme": theme_rows,
    }[source]
    rows = asof_join(on_dates(wanted, dates), one_day, ["ticker"], "date", ["r1"])
    bench = one_day.select(F.col("ticker").alias("benchmark"), "date", F.col("r1").alias("b1"))
    rows = asof_join(rows, bench, ["benchmark"], "date", ["b1"])
    m = one_day.filter(F.col("ticker") == market).select(F.lit("m").alias("_m"), "date", F.col("r1").alias("m1"))
    mdays = asof_join(dates.select("date").distinct().withColumn("_m", F.lit("m")), m, ["_m"], "date", ["m1"], unique=True)
    rows = rows.join(mdays.drop("_m"), "date")
    t, b, mk = F.col("r1"), F.col("b1"), F.col("m1")
    pct = lambda c: F.round(c * 100, 2)
    flagged = rows.withColumn("strength", divergence_strength(t, mk, b, F.col("source") == "theme")).filter(
        F.col("strength").isNotNull()
    )
    out = flagged.select(
        "date",
        "ticker",
        pct(t).alias("ticker_1d"),
        pct(mk).alias("market_1d"),
        "benchmark",
        pct(b).alias("benchmark_1d"),
        pct(t - mk).alias("divergence_vs_market"),
        pct(t - b).alias("divergence_vs_benchmark"),
        "strength",
        "theme",
        "parent",
        "source",
    )
    w = Window.partitionBy("date").orderBy(F.desc("divergence_vs_benchmark"), "source", "ticker")
    return out.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= n)
