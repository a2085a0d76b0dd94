"""Walk-forward evaluation: observations in long form, ICs, buckets and verdicts.

Every evaluation returns tidy frames. Observations have
(segment, date, ticker, horizon, score, fwd) and a date half; ICs per date are
windows over one date's cross-section, pooled ICs use ranks computed across partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators import features as ft
from crosstide.operators.asof import asof_forward, asof_grid, asof_join
from crosstide.operators.graph import unique_edges
from crosstide.operators.ic import (
    ic_summary,
    long_horizons,
    pivot_halves,
    spearman,
    with_all,
    with_date_half,
    with_row_half,
)
from crosstide.operators.ranking import (
    action_label,
    backtest_regime,
    in_correction,
    regime,
    top_quintile,
    with_cross_section,
)
from crosstide.plans.insiders import insider_buy_days, insider_score, score_label
from crosstide.plans.signals import (
    SIGNALS,
    basket_zscore,
    confirm_backtest,
    every_nth_date,
    megacap_composite,
    on_dates,
    pair_signal,
    sector_rotation,
    with_parent,
)
from crosstide.session import reliable_checkpoint

HORIZONS = (5, 10, 20)
ACTIONS = ("STRONG_BUY", "BUY", "HOLD", "SELL")


class Evaluation:
    """Named frames of one evaluation, each built when it is first asked for.

    Pooled ranks run a job when they are built, so unused ones must cost nothing.
    """

    def __init__(self, **frames: Callable[[], DataFrame]):
        self._frames = frames

    def __getattr__(self, name: str) -> DataFrame:
        try:
            frame = self.__dict__["_frames"][name]
        except KeyError:
            raise AttributeError(name) from None
        value = frame()
        setattr(self, name, value)
        return value


def date_ic(obs: DataFrame, rank: str, min_n: int, ddof: int = 1) -> DataFrame:
    """Summary of per-date ICs by (segment, horizon, half): n_dates, mean, std, ir."""
    ics = spearman(obs, ["segment", "horizon", "date", "half"], rank, min_n, ties=("ticker",))
    return ic_summary(with_all(ics), ["segment", "horizon", "half"], ddof)


def pooled_ic(obs: DataFrame, rank: str, min_n: int, ties: Sequence[str] = ("date", "ticker"), halves: bool = False) -> DataFrame:
    """Pooled IC by (segment, horizon), with H1 and H2 columns on request."""
    if halves:
        both = with_all(obs)
        return pivot_halves(spearman(both, ["segment", "horizon", "half"], rank, min_n, ties, pooled=True), ["segment", "horizon"])
    return spearman(obs, ["segment", "horizon"], rank, min_n, ties, pooled=True)


def bucket_means(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean and hit rate (share above zero) of the forward returns that exist."""
    return obs.groupBy(*keys).agg(
        F.count("fwd").alias("n"),
        F.avg("fwd").alias("avg_fwd"),
        F.avg(F.when(F.col("fwd").isNotNull(), (F.col("fwd") > 0).cast("double"))).alias("hit_rate"),
    )


def coverage(obs: DataFrame, rank: str, min_n: int, min_obs: int = 100, reference: int = 5, min_dates: int = 0) -> DataFrame:
    """One row: dates, split and whether there are enough dates, and observations at the reference horizon.

    ``n_obs`` counts the pairs of the dates that gave an IC.
    """
    ics = spearman(obs.filter(F.col("horizon") == reference), ["date"], rank, min_n, ties=("ticker",))
    n_obs = ics.agg(F.coalesce(F.sum(F.when(F.col("ic").isNotNull(), F.col("n"))), F.lit(0)).alias("n")).scalar()
    days = obs.select("date", "half").distinct()
    return days.agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.min(F.when(F.col("half") == "H2", F.col("date"))).alias("mid_date"),
        F.count(F.when(F.col("half") == "H1", 1)).alias("n_h1"),
        F.count(F.when(F.col("half") == "H2", 1)).alias("n_h2"),
    ).select("*", n_obs.alias("n_obs"), ((n_obs >= min_obs) & (F.col("n_dates") >= min_dates)).alias("sufficient"))


def explode_segments(obs: DataFrame, *segments: tuple[str, Column | None], score: dict[str, str] | None = None) -> DataFrame:
    """Repeat each row once per segment whose condition holds (None = always).

    ``score`` names the score column of a segment where it is not ``score``.
    """
    score = score or {}
    items = [
        F.when(
            F.lit(True) if cond is None else F.coalesce(cond, F.lit(False)),
            F.struct(F.lit(name).alias("segment"), F.col(score.get(name, "score")).cast("double").alias("score")),
        )
        for name, cond in segments
    ]
    rest = [c for c in obs.columns if c not in ("segment", "score")]
    exploded = obs.withColumn("_s", F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())))
    return exploded.select(*rest, "_s.segment", "_s.score")


# ---- verdicts -----------------------------------------------------------------------


def pass_verdict(ic: Column, h1: Column, h2: Column, n: Column, min_n: int = 100) -> Column:
    """INSUF below ``min_n``; N/A when an IC is missing; PASS above 0.05 with both halves positive."""
    return (
        F.when(n < min_n, "INSUF")
        .when(ic.isNull() | h1.isNull() | h2.isNull(), "N/A")
        .when((ic > 0.05) & (h1 > 0) & (h2 > 0), "PASS")
        .otherwise("FAIL")
    )


def three_way_verdict(ic: Column, h1: Column, h2: Column) -> Column:
    """PASS, MARGINAL (positive but at most 0.05) or FAIL; both halves must be positive."""
    halves = F.coalesce((h1 > 0) & (h2 > 0), F.lit(False))
    return F.when((ic > 0.05) & halves, "PASS").when((ic > 0) & halves, "MARGINAL").otherwise("FAIL")


def sufficiency(n: Column) -> Column:
    return F.when(n >= 100, "OK").when(n >= 50, "MARGINAL").otherwise("INSUFFICIENT")


def passes_at_any(wide: DataFrame, keys: Sequence[str], horizons: Sequence[int] = (10, 20), min_n: int | Column = 30) -> DataFrame:
    """True when any of ``horizons`` has IC above 0.05 with both halves positive.

    ``wide`` has one row per key and horizon with n_obs, ic, ic_h1, ic_h2. ``min_n`` may be one of ``keys``.
    """
    good = (F.col("ic") > 0.05) & (F.col("ic_h1") > 0) & (F.col("ic_h2") > 0) & F.col("horizon").isin(*horizons)
    return wide.groupBy(*keys).agg(
        F.max("n_obs").alias("n_obs"),
        (F.coalesce(F.bool_or(good), F.lit(False)) & (F.max("n_obs") >= min_n)).alias("passes"),
    )


def stability(h1: Column, h2: Column) -> Column:
    return F.when(h1.isNull() | h2.isNull(), "?").when((h1 > 0.05) & (h2 > 0.05), "YES").when((h1 > 0) & (h2 > 0), "weak").otherwise("NO")


# ---- graph walk-forward -------------------------------------------------------------


def _in_window(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    return bars


def rebalance_dates(bars: DataFrame, lookback: int = 20, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every fifth trading date of the window after the lookback, without the last one."""
    return every_nth_date(_in_window(bars, start, end), 5, lookback, drop_last=True)


def require_history(bars: DataFrame, edges: DataFrame, need: int, start: str | None, end: str | None, parents: Sequence[str] | None) -> None:
    """Errors for a window of fewer than ``need`` trading dates and for parents without an edge."""
    if parents:
        # at most one row per name asked for
        known = {r["parent"] for r in edges.filter(F.col("parent").isin(*parents)).select("parent").distinct().collect()}
        unknown = sorted(set(parents) - known)
        if unknown:
            raise ValueError(f"unknown parents: {unknown}")
    n = _in_window(bars, start, end).agg(F.count_distinct("date")).first()[0]
    if n < need:
        raise ValueError(f"insufficient price history: {n} trading dates, {need} are needed")


def rebalanced_states(bars: DataFrame, dates: DataFrame, horizon: int = 5, lookback: int = 20) -> DataFrame:
    """State and outcome of every ticker on every rebalancing date, from its own last row; written once.

    ret and vol over the lookback, ret_20d and vol_20d for the diagnostics; fwd enters at the
    next close, diag_<h> at the first close on or after the date: a date on which the ticker
    trades starts them at that row, any other date at the next one. Everything ahead is a lead
    on that row. A ticker has no row before its first bar.
    """
    diag = (1, 5, 10, 20)
    ahead = sorted({1, horizon, *diag, *(h + 1 for h in diag)})
    feats = ft.with_realized_vol(bars.select("ticker", "date", ft.PRICE))
    if lookback != 20:
        feats = ft.with_realized_vol(feats, lookback, "vol")
    feats = feats.select(
        "ticker",
        "date",
        ft.ret(lookback).alias("ret"),
        F.col("vol_20d" if lookback == 20 else "vol").alias("vol"),
        ft.ret(20).alias("ret_20d"),
        "vol_20d",
        F.col(ft.PRICE).alias("_a0"),
        *[F.lead(ft.PRICE, k).over(ft.per_ticker()).alias(f"_a{k}") for k in ahead],
    )
    grid = asof_grid(feats, dates, ["ticker"], "date", feats.columns[2:], fact_date="_own")
    change = lambda to, base: ft.ratio(to - base, base)
    traded = F.col("_own") == F.col("date")
    step = lambda h: F.when(traded, F.col(f"_a{h}")).otherwise(F.col(f"_a{h + 1}"))
    states = grid.select(
        "ticker", "date", "ret", "vol", "ret_20d", "vol_20d",
        change(F.col(f"_a{horizon}"), F.col("_a1")).alias("fwd"),
        *[change(step(h), step(0)).alias(f"diag_{h}") for h in diag],
    )
    return reliable_checkpoint(states)


def walk_forward_obs(
    bars: DataFrame,
    edges: DataFrame,
    signal: str = "rs",
    horizon: int = 5,
    lookback: int = 20,
    start: str | None = None,
    end: str | None = None,
    parents: Sequence[str] | None = None,
    tickers: Sequence[str] | None = None,
    states: DataFrame | None = None,
) -> DataFrame:
    """Observations of every fifth trading date: score, action, returns, risk and parent state.

    Prices before the window count towards lookbacks. Both sides of a pair meet
    ``states`` (``rebalanced_states`` of the same window, made here unless given) by
    equality; a registered signal of another form is scored by its own function first.
    """
    if signal not in SIGNALS:
        raise ValueError(f"unknown signal {signal!r}; available: {sorted(SIGNALS)}")
    require_history(bars, edges, lookback + horizon + 10, start, end, parents)
    e = unique_edges(edges)
    if parents:
        e = e.filter(F.col("parent").isin(*parents))
    if tickers:
        e = e.filter(F.col("child").isin(*tickers))
    dates = rebalance_dates(bars, lookback, start, end)
    if states is None:
        states = rebalanced_states(bars, dates, horizon, lookback)
    led = states.select(F.col("ticker").alias("parent"), "date", F.col("ret").alias("p_ret"), F.col("ret_20d").alias("parent_ret_20d"))
    own = states.drop("ret_20d")
    score = pair_signal(signal)
    if score is None:
        scored = SIGNALS[signal](bars, e, lookback, dates).select("ticker", "parent", "date", "score")
        rows = scored.join(own, ["ticker", "date"], "left").join(led, ["parent", "date"], "left")
    else:
        # a pair has no score where a side has no state
        pairs = e.select(F.col("child").alias("ticker"), "parent", "weight")
        rows = pairs.join(own, "ticker").join(led, ["parent", "date"]).withColumn("score", score).filter(F.col("score").isNotNull())
    return with_cross_section(rows, ["date"], "score").select(
        "ticker",
        "parent",
        "date",
        "score",
        action_label(F.col("pct_below")).alias("action"),
        "fwd",
        *[f"diag_{h}" for h in (1, 5, 10, 20)],
        "vol_20d",
        "parent_ret_20d",
    )


def split_dates(obs: DataFrame) -> DataFrame:
    """One row: dates, and the first, middle and last of them; NULL with fewer than four, which are not split."""
    days = with_date_half(obs.select("date").distinct())
    split = lambda c: F.when(F.count(F.lit(1)) >= 4, c)
    return days.agg(
        F.count(F.lit(1)).alias("n_dates"),
        split(F.min("date")).alias("start_date"),
        split(F.min(F.when(F.col("half") == "H2", F.col("date")))).alias("mid_date"),
        split(F.max("date")).alias("end_date"),
    )


def quintile_stats(obs: DataFrame) -> DataFrame:
    """Per action: count, mean forward returns, hit rate of the primary horizon, mean volatility."""
    actions = obs.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    stats = obs.groupBy("action").agg(
        F.count(F.lit(1)).alias("count"),
        *[F.avg(f"diag_{h}").alias(f"avg_fwd_{h}d") for h in (1, 5, 10, 20)],
        F.avg((F.col("fwd") > 0).cast("double")).alias("hit_rate"),
        F.avg("vol_20d").alias("avg_vol_20d"),
    )
    return actions.join(stats, "action", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def vol_ratio_flag(quintiles: DataFrame) -> DataFrame:
    """Volatility of STRONG_BUY over HOLD and whether it is at least double."""
    v = lambda a: F.max(F.when(F.col("action") == a, F.col("avg_vol_20d")))
    r = ft.ratio(v("STRONG_BUY"), v("HOLD"))
    return quintiles.agg(r.alias("vol_ratio"), F.coalesce(r >= 2.0, F.lit(False)).alias("flagged"))


def segment_ic(obs: DataFrame, min_n: int = 5, min_half: int = 20) -> DataFrame:
    """Average-rank IC per parent, parent direction and parent regime, and per regime and half.

    Constant or small segments are left out. Halves need at least four dates. The
    observations are written once; the ranks and halves read that table.
    """
    obs = reliable_checkpoint(obs.select("date", "ticker", "parent", "score", "fwd", "parent_ret_20d"))
    r = F.col("parent_ret_20d")
    n_dates = obs.select("date").distinct().agg(F.count(F.lit(1))).scalar()
    halves = with_date_half(obs)
    part = lambda kind, seg, half: F.when(
        seg.isNotNull(), F.struct(F.lit(kind).alias("kind"), seg.alias("segment"), half.alias("half"))
    )
    direction = F.when(r > 0, "strong").when(r.isNotNull(), "weak")
    items = F.array(
        part("parent", F.col("parent"), F.lit("ALL")),
        part("direction", direction, F.lit("ALL")),
        part("regime", backtest_regime(r), F.lit("ALL")),
        part("regime", backtest_regime(r), F.col("half")),
    )
    rows = halves.withColumn("_s", F.explode(F.filter(items, lambda s: s.isNotNull()))).select(
        "date", "ticker", "score", "fwd", "_s.kind", "_s.segment", F.col("_s.half").alias("half")
    )
    ics = spearman(rows, ["kind", "segment", "half"], "average", 1, pooled=True)
    need = F.when(F.col("half") == "ALL", min_n).otherwise(min_half)
    return ics.filter(
        F.col("ic").isNotNull() & (F.col("n") >= need) & ((F.col("half") == "ALL") | (n_dates >= 4))
    )


def period_returns(obs: DataFrame, dates: DataFrame) -> DataFrame:
    """Equal-weight return of the top-quintile children per rebalancing date; an empty basket returns 0.

    A child picked under two parents counts once.
    """
    basket = top_quintile(obs, ["parent", "date"], "score").select("date", "ticker", "fwd").distinct()
    means = basket.groupBy("date").agg(F.avg("fwd").alias("_r"))
    return dates.join(means, "date", "left").select("date", F.coalesce("_r", F.lit(0.0)).alias("period_return"))


def performance(returns: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """Annualised Sharpe ratio and maximum drawdown of a series of period returns per run.

    A run has one row per rebalancing date, so its running product is a bounded window.
    """
    keys = list(keys)
    run = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("_c", F.product(1 + F.col("period_return")).over(run))
    curve = curve.withColumn("_peak", F.max("_c").over(run))
    sd = F.stddev_pop("period_return")
    sharpe = F.avg("period_return") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(252.0 / horizon))
    return curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"),
        F.min((F.col("_c") - F.col("_peak")) / F.nullif(F.col("_peak"), F.lit(0.0))).alias("max_drawdown"),
    )


def drawdown_curve(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative value, running maximum and drawdown per period of each run."""
    run = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("cumulative", F.product(1 + F.col("period_return")).over(run))
    return curve.withColumn("peak", F.max("cumulative").over(run)).withColumn(
        "drawdown", (F.col("cumulative") - F.col("peak")) / F.nullif(F.col("peak"), F.lit(0.0))
    )


def walk_forward(
    bars: DataFrame,
    edges: DataFrame,
    signal: str = "rs",
    horizon: int = 5,
    lookback: int = 20,
    start: str | None = None,
    end: str | None = None,
    parents: Sequence[str] | None = None,
    tickers: Sequence[str] | None = None,
) -> DataFrame:
    """One row: Sharpe, drawdown and IC summary (population deviation) of the rebalanced signal."""
    if signal not in SIGNALS:
        raise ValueError(f"unknown signal {signal!r}; available: {sorted(SIGNALS)}")
    states = rebalanced_states(bars, rebalance_dates(bars, lookback, start, end), horizon, lookback)
    obs = walk_forward_obs(bars, edges, signal, horizon, lookback, start, end, parents, tickers, states)
    obs = reliable_checkpoint(obs.select("ticker", "parent", "date", "score", "fwd"))
    ics = ic_summary(spearman(obs, ["date"], "average", 5), [], ddof=0)
    # some ticker trades on every rebalancing date, so the states name them all
    perf = performance(period_returns(obs, states.select("date").distinct()), horizon)
    # one row each: the IC summary rides along as a scalar
    ic = ics.select(F.struct("n_dates", "ic_mean", "ic_std", "ic_ir")).scalar()
    zero = F.lit(0.0)
    return perf.withColumn("_ic", ic).select(
        "n_periods",
        "sharpe",
        "max_drawdown",
        F.col("_ic.n_dates").alias("n_ic"),
        *[F.coalesce(f"_ic.{c}", zero).alias(c) for c in ("ic_mean", "ic_std", "ic_ir")],
    )


# ---- relative volume ----------------------------------------------------------------


def rvol_backtest(bars: DataFrame, members: DataFrame, horizons: Sequence[int] = HORIZONS) -> Evaluation:
    """Signed relative volume against the return from the signal close.

    Pooled segments: unsigned, direction, megacap and dependent (signed). Buckets are
    mean returns after volume at least twice the average, by direction.
    """
    feats = bars.select(
        "ticker", "date", ft.PRICE, ft.rvol(20, "backtest").alias("rvol"), F.signum(ft.ret(1)).alias("direction")
    )
    long = long_horizons(feats, horizons, "signal_close").filter(F.col("rvol").isNotNull() & F.col("direction").isNotNull())
    long = with_date_half(long)
    member = members.select("ticker", F.lit(True).alias("_m")).distinct()
    obs = long.join(member, "ticker", "left").withColumn("signed", F.col("rvol") * F.col("direction"))
    by_date = obs.withColumn("segment", F.lit("all")).withColumn("score", F.col("signed"))
    pooled = explode_segments(
        obs,
        ("unsigned", None),
        ("direction", None),
        ("megacap", F.col("_m").isNotNull()),
        ("dependent", F.col("_m").isNull()),
        score={"unsigned": "rvol", "direction": "direction", "megacap": "signed", "dependent": "signed"},
    )
    high = obs.filter((F.col("rvol") >= 2) & (F.col("direction") != 0)).withColumn(
        "bucket", F.when(F.col("direction") > 0, "up_high_rvol").otherwise("down_high_rvol")
    )
    return Evaluation(
        obs=lambda: by_date,
        date_ic=lambda: date_ic(by_date, "ordinal", 3),
        pooled_ic=lambda: pooled_ic(pooled, "ordinal", 3),
        buckets=lambda: bucket_means(high, ["bucket", "horizon"]),
    )


# ---- estimate revisions -------------------------------------------------------------


def estimates_backtest(estimates: DataFrame, bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> Evaluation:
    """Revision score at each snapshot; entry is the last close on or before it."""
    snaps = estimates.filter(F.col("revision_score").isNotNull()).select(
        "ticker", "date", F.col("revision_score").cast("double").alias("score")
    )
    px = bars.select("ticker", "date", ft.PRICE)
    rows = asof_join(snaps, px, ["ticker"], "date", [ft.PRICE], unique=True)
    rows = asof_forward(rows, px, ["ticker"], "date", ft.PRICE, horizons)
    f = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), ft.ratio(F.col(f"fwd_{h}") - F.col(ft.PRICE), F.col(ft.PRICE)).alias("fwd"))
            for h in horizons
        ]
    )
    long = with_date_half(rows.withColumn("_f", F.explode(f)).select("ticker", "date", "score", "_f.horizon", "_f.fwd"))
    long = long.withColumn("segment", F.lit("all"))
    signed = long.filter(F.col("score") != 0).withColumn("bucket", F.when(F.col("score") > 0, "positive").otherwise("negative"))
    return Evaluation(
        obs=lambda: long,
        date_ic=lambda: date_ic(long, "ordinal", 3),
        buckets=lambda: bucket_means(signed, ["bucket", "horizon"]),
    )


def bucket_spread(buckets: DataFrame, high: str, low: str) -> DataFrame:
    """Mean of ``high`` minus mean of ``low`` per horizon."""
    at = lambda b: F.max(F.when(F.col("bucket") == b, F.col("avg_fwd")))
    return buckets.groupBy("horizon").agg((at(high) - at(low)).alias("spread"))


# ---- confirmation -------------------------------------------------------------------

CONFIRM_WARMUP = 51


def confirmation_features(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Score parts of every row after the warm-up: own strength, volume, buying, average."""
    feats = bars.select(
        "ticker",
        "date",
        ft.PRICE,
        ft.ret(20).alias("ret_20d"),
        F.when(ft.rows_seen() > 20, ft.rvol(20, "lenient")).alias("rvol"),
        ft.above_ma(50).alias("above"),
        ft.rows_seen().alias("_pos"),
        *[ft.forward_return(h, "signal_close").alias(f"_f{h}") for h in HORIZONS],
    ).filter(F.col("_pos") > CONFIRM_WARMUP)
    buys = insider_buy_days(trades).withColumn("insider", F.lit(True))
    return feats.join(buys, ["ticker", "date"], "left").withColumn("insider", F.coalesce("insider", F.lit(False)))


def _confirm_long(feats: DataFrame, positive: Column) -> DataFrame:
    scored = feats.withColumn("rs_positive", F.coalesce(positive, F.lit(False))).withColumn(
        "score", confirm_backtest(F.col("rs_positive"), F.col("rvol"), F.col("insider"), F.col("above")).cast("double")
    )
    keep = [c for c in scored.columns if not c.startswith("_f")]
    f = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in HORIZONS])
    # a row without any forward return is no observation
    some = F.coalesce(*[F.col(f"_f{h}") for h in HORIZONS]).isNotNull()
    long = scored.filter(some).withColumn("_f", F.explode(f)).select(*keep, "_f.horizon", "_f.fwd")
    return long.withColumn("rs_only", F.col("rs_positive").cast("double")).withColumn(
        "bucket", F.when(F.col("score") <= 1, "0-1").when(F.col("score") == 2, "2").otherwise("3-4")
    )


def confirmation_backtest(bars: DataFrame, trades: DataFrame, members: DataFrame, benchmark: DataFrame | None = None) -> Evaluation:
    """Confirmation score 0 to 4 over all tickers.

    Members are measured against the benchmark's as-of return, everyone else (and
    members without a benchmark series) by their own return.
    """
    feats = confirmation_features(bars, trades)
    member = members.select("ticker", F.lit(True).alias("_m")).distinct()
    feats = feats.join(member, "ticker", "left")
    positive = F.col("ret_20d") > 0
    if benchmark is not None:
        b = benchmark.withColumn("ticker", F.lit("b")).select("ticker", "date", ft.ret(20).alias("b_ret"))
        days = bars.select("date").distinct().withColumn("ticker", F.lit("b"))
        feats = feats.join(asof_join(days, b, ["ticker"], "date", ["b_ret"], unique=True).drop("ticker"), "date", "left")
        positive = F.when(F.col("_m").isNotNull(), F.col("ret_20d") - F.col("b_ret") > 0).otherwise(F.col("ret_20d") > 0)
    long = with_date_half(_confirm_long(feats, positive))
    by_date = long.withColumn("segment", F.lit("all"))
    pooled = explode_segments(
        long,
        ("megacap", F.col("_m").isNotNull()),
        ("dependent", F.col("_m").isNull()),
        ("rs_only", None),
        ("score", None),
        score={"rs_only": "rs_only"},
    )
    return Evaluation(
        obs=lambda: by_date,
        date_ic=lambda: date_ic(by_date, "ordinal", 3),
        pooled_ic=lambda: pooled_ic(pooled, "ordinal", 3),
        buckets=lambda: bucket_means(long, ["bucket", "horizon"]),
    )


def qualifying_parents(
    bars: DataFrame, edges: DataFrame, parents: DataFrame, validated: Sequence[str]
) -> DataFrame:
    """Per child and date: mean return of its parents in correction that day, and whether any is validated.

    A parent counts on dates of its own series only. ``parents`` has one column ticker.
    """
    falling = (
        bars.join(parents, "ticker", "left_semi")
        .select(F.col("ticker").alias("parent"), "date", ft.ret(20).alias("p_ret"))
        .filter(in_correction(F.col("p_ret")))
    )
    pairs = unique_edges(edges).select(F.col("child").alias("ticker"), "parent")
    return (
        pairs.join(falling, "parent")
        .groupBy("ticker", "date")
        .agg(
            F.avg("p_ret").alias("parent_mean"),
            F.count(F.lit(1)).alias("n_parents"),
            F.bool_or(F.col("parent").isin(*validated)).alias("is_validated"),
        )
    )


def confirmation_regime_backtest(
    bars: DataFrame, trades: DataFrame, edges: DataFrame, parents: DataFrame, validated: Sequence[str]
) -> Evaluation:
    """The confirmation score of dependents on dates one of their parents is in correction."""
    feats = confirmation_features(bars, trades).join(parents, "ticker", "left_anti")
    feats = feats.join(qualifying_parents(bars, edges, parents, validated), ["ticker", "date"])
    long = with_date_half(_confirm_long(feats, F.col("ret_20d") > 0))
    segs = lambda score: explode_segments(
        long, ("all", None), ("validated", F.col("is_validated")), score={"all": score, "validated": score}
    )
    scored = segs("score")
    rs_only = segs("rs_only").withColumn("segment", F.concat("segment", F.lit("_rs_only")))
    return Evaluation(
        obs=lambda: scored,
        date_ic=lambda: date_ic(scored, "ordinal", 3),
        pooled_ic=lambda: pooled_ic(scored.unionByName(rs_only), "ordinal", 3),
        buckets=lambda: bucket_means(scored, ["segment", "bucket", "horizon"]),
    )


# ---- rotation -----------------------------------------------------------------------


def rotation_backtest(
    bars: DataFrame,
    sector_bars: DataFrame,
    edges: DataFrame,
    validated: DataFrame,
    parents: DataFrame,
    sectors: Sequence[str],
    focus: str,
    market: str,
) -> Evaluation:
    """Strength against the mean of the correcting validated parents, split by the focus sector's rank.

    Segments: baseline, LEADING (rank 1 or 2), not-LEADING. Needs 61 rows of every sector.
    The information-ratio proxy is IC over the sample deviation of the returns.
    """
    q = qualifying_parents(bars, edges, validated, [])
    feats = bars.select(
        "ticker", "date", ft.PRICE, ft.ret(20).alias("ret_20d"), ft.rows_seen().alias("_pos"),
        *[ft.forward_return(h, "signal_close").alias(f"_f{h}") for h in HORIZONS],
    ).filter(F.col("_pos") > CONFIRM_WARMUP)
    feats = feats.join(parents, "ticker", "left_anti").join(q, ["ticker", "date"])
    rows = feats.withColumn("score", F.col("ret_20d") - F.col("parent_mean")).filter(
        F.col("score").isNotNull() & F.coalesce(*[F.col(f"_f{h}") for h in HORIZONS]).isNotNull()
    )
    rot = sector_rotation(sector_bars, sectors, focus, market, bars.select("date").distinct(), min_rows=61)
    leading = rot.filter("data_available").select("date", (F.col("focus_rank") <= 2).alias("leading"))
    rows = with_date_half(rows.join(leading, "date", "left"))
    f = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in HORIZONS])
    long = rows.withColumn("_f", F.explode(f)).select(
        "ticker", "date", "half", "score", "leading", "_f.horizon", "_f.fwd"
    ).filter(F.col("fwd").isNotNull())
    obs = explode_segments(long, ("baseline", None), ("LEADING", F.col("leading")), ("not-LEADING", ~F.col("leading")))
    return Evaluation(obs=lambda: obs, pooled_ic=lambda: _rotation_ics(obs))


def _rotation_ics(obs: DataFrame) -> DataFrame:
    pooled = pooled_ic(obs, "ordinal", 3, halves=True)
    spread = obs.groupBy("segment", "horizon").agg(F.stddev_samp("fwd").alias("_sd"))
    size = pooled.filter("horizon = 5").select("segment", sufficiency(F.col("n")).alias("sufficiency"))
    return (
        pooled.join(spread, ["segment", "horizon"])
        .withColumn("ir_proxy", ft.ratio(F.col("ic"), F.col("_sd")))
        .drop("_sd")
        .join(size, "segment", "left")
    )


def segment_delta(pooled: DataFrame, segment: str, baseline: str) -> DataFrame:
    """IC of a segment minus the baseline's, per horizon."""
    at = lambda s: F.max(F.when(F.col("segment") == s, F.col("ic")))
    return pooled.groupBy("horizon").agg(
        at(baseline).alias("ic_baseline"), at(segment).alias("ic_segment"), (at(segment) - at(baseline)).alias("delta")
    )


# ---- baskets and themes -------------------------------------------------------------


def basket_obs(bars: DataFrame, baskets: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """z and z times rvol of members trading that day, long over horizons (signal close)."""
    z = basket_zscore(bars, baskets).filter(F.col("z").isNotNull())
    fwd = long_horizons(bars.select("ticker", "date", ft.PRICE), horizons, "signal_close").select("ticker", "date", "horizon", "fwd")
    return z.join(fwd, ["ticker", "date"]).select("theme", "ticker", "date", "ret", "z", "combined", "horizon", "fwd")


def zscore_backtest(bars: DataFrame, basket: DataFrame, since: str = "2024-01-01", order: str = "position") -> Evaluation:
    """Basket z-score, full history and since a date, each with its own halves.

    ``basket`` has theme, ticker and position; equal scores are ordered by date and position.
    """
    rows = basket_obs(bars, basket).join(basket.select("theme", "ticker", F.col(order).alias("_order")), ["theme", "ticker"])
    recent = F.col("date") >= F.lit(since).cast("date")
    windows = F.filter(F.array(F.lit("full"), F.when(recent, "since")), lambda v: v.isNotNull())
    rows = rows.withColumn("window", F.explode(windows))
    # halves are set on dates with an observation, whether or not it has a forward return
    rows = with_date_half(rows, ["theme", "window"])
    items = F.array(
        F.struct(F.lit("z").alias("signal"), F.col("z").alias("score")),
        F.struct(F.lit("z_rvol").alias("signal"), F.col("combined").alias("score")),
    )
    rows = rows.withColumn("_s", F.explode(items)).withColumn("segment", F.concat_ws("/", "theme", "window", "_s.signal"))
    rows = rows.select("segment", "ticker", "_order", "date", "half", "horizon", "fwd", "_s.score")
    return Evaluation(
        obs=lambda: rows, pooled_ic=lambda: pooled_ic(rows, "ordinal", 3, ties=("date", "_order"), halves=True)
    )


def pair_obs(
    bars: DataFrame, pairs: DataFrame, horizons: Sequence[int] = HORIZONS, skip: int = 20, trailing: int = 20
) -> DataFrame:
    """Strength against a benchmark on the dates both trade, without the first and last rows.

    ``pairs`` has ticker and benchmark. One row per (ticker, benchmark, date, horizon), next-close returns.
    """
    feats = bars.select("ticker", "date", ft.ret(20).alias("r"), *[ft.forward_return(h).alias(f"_f{h}") for h in horizons])
    bench = feats.select(F.col("ticker").alias("benchmark"), "date", F.col("r").alias("b"))
    both = feats.join(pairs.select("ticker", "benchmark").distinct(), "ticker").join(bench, ["benchmark", "date"])
    series = Window.partitionBy("ticker", "benchmark")
    both = both.withColumn("_pos", F.row_number().over(series.orderBy("date"))).withColumn("_len", F.count(F.lit(1)).over(series))
    rows = both.filter((F.col("_pos") > skip) & (F.col("_pos") <= F.greatest(F.lit(skip), F.col("_len") - trailing)))
    rows = rows.withColumn("score", F.col("r") - F.col("b")).filter(
        F.col("score").isNotNull() & F.coalesce(*[F.col(f"_f{h}") for h in horizons]).isNotNull()
    )
    return rows


def _per_series(rows: DataFrame, keys: Sequence[str], horizons: Sequence[int], min_obs: int | Column) -> DataFrame:
    """ICs of one series' observations, halves by row position; series below ``min_obs`` keep NULL ICs.

    A group is one series, bounded by the calendar, so its size travels with its rows.
    """
    keys = list(keys)
    rows = with_row_half(rows, keys).withColumn("n_obs", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    f = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in horizons])
    long = with_all(rows.withColumn("_f", F.explode(f)).select(*keys, "n_obs", "date", "score", "half", "_f.horizon", "_f.fwd"))
    ics = pivot_halves(spearman(long, [*keys, "n_obs", "horizon", "half"], "average", 5), [*keys, "n_obs", "horizon"])
    enough = F.col("n_obs") >= min_obs
    return ics.select(*keys, "horizon", "n_obs", *[F.when(enough, F.col(c)).alias(c) for c in ("ic", "ic_h1", "ic_h2")])


def theme_backtest(bars: DataFrame, themes: DataFrame, min_obs: int = 30) -> Evaluation:
    """Frames per_ticker (by horizon), verdicts (per ticker) and combined (pooled by horizon)."""
    rows = pair_obs(bars, themes)
    keys = ["ticker", "benchmark"]
    f = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in HORIZONS])
    long = rows.withColumn("_f", F.explode(f)).select("ticker", "date", "score", "_f.horizon", "_f.fwd").withColumn(
        "segment", F.lit("combined")
    )
    return Evaluation(
        obs=lambda: rows,
        per_ticker=lambda: _per_series(rows, keys, HORIZONS, min_obs),
        verdicts=lambda: passes_at_any(_per_series(rows, keys, HORIZONS, min_obs), keys, min_n=min_obs),
        combined=lambda: pooled_ic(long, "average", 5),
    )


#: Windows of the catalyst evaluation: name, first date (None = all history), fewest observations.
CATALYST_WINDOWS = (("full", None, 100), ("recent", "2024-01-01", 30))


def catalyst_backtest(
    bars: DataFrame, pairs: DataFrame, broad: str, start: str | None = None, min_obs: int = 30
) -> tuple[DataFrame, DataFrame]:
    """``catalyst_windows`` of the one window from ``start``, without its name."""
    per, verdicts = catalyst_windows(bars, pairs, broad, [("window", start, min_obs)])
    return per.drop("window"), verdicts.drop("window")


def catalyst_windows(
    bars: DataFrame, pairs: DataFrame, broad: str, windows: Sequence[tuple[str, str | None, int]] = CATALYST_WINDOWS
) -> tuple[DataFrame, DataFrame]:
    """Three signals per ticker and window: relative volume, strength vs a broad and vs its own benchmark.

    Returns ICs per (window, ticker, benchmark, signal, horizon) and one verdict row per (window, ticker)
    with its best signal. The last 20 dates of a window are left out. A row counts in every window
    that it lies in, so the features and both benchmarks are looked up once.
    """
    feats = bars.select(
        "ticker", "date", ft.ret(20).alias("r"), ft.rvol(20, "strict").alias("rvol"),
        *[ft.forward_return(h).alias(f"_f{h}") for h in HORIZONS],
    )
    own = feats.join(pairs.select("ticker", "benchmark").distinct(), "ticker").withColumn("broad", F.lit(broad))
    if all(start for _, start, _ in windows):
        own = own.filter(F.col("date") >= F.lit(min(start for _, start, _ in windows)).cast("date"))
    bench = feats.select(F.col("ticker").alias("benchmark"), "date", F.col("r").alias("b"))
    wide = feats.filter(F.col("ticker") == broad).select(F.col("ticker").alias("broad"), "date", F.col("r").alias("x"))
    own = asof_join(asof_join(own, bench, ["benchmark"], "date", ["b"]), wide, ["broad"], "date", ["x"])
    inside = F.array(
        *[
            F.when(F.col("date") >= F.lit(start).cast("date") if start else F.lit(True), F.struct(F.lit(name).alias("window"), F.lit(n).alias("min_obs")))
            for name, start, n in windows
        ]
    )
    own = own.withColumn("_w", F.explode(F.filter(inside, lambda w: w.isNotNull()))).select("*", "_w.window", "_w.min_obs")
    series = Window.partitionBy("window", "ticker", "benchmark")
    own = (
        own.withColumn("_pos", F.row_number().over(series.orderBy("date")))
        .withColumn("_len", F.count(F.lit(1)).over(series))
        .filter(F.col("_pos") <= F.col("_len") - 20)
    )
    items = F.array(
        F.struct(F.lit("rvol").alias("signal"), F.col("rvol").alias("score")),
        F.struct(F.lit("rs_vs_broad").alias("signal"), (F.col("r") - F.col("x")).alias("score")),
        F.struct(F.lit("rs_vs_benchmark").alias("signal"), (F.col("r") - F.col("b")).alias("score")),
    )
    some = F.coalesce(*[F.col(f"_f{h}") for h in HORIZONS]).isNotNull()
    rows = own.filter(some).withColumn("_s", F.explode(items)).select(
        "window", "min_obs", "ticker", "benchmark", "date", *[f"_f{h}" for h in HORIZONS], "_s.signal", "_s.score"
    ).filter(F.col("score").isNotNull())
    per = _per_series(rows, ["window", "min_obs", "ticker", "benchmark", "signal"], HORIZONS, F.col("min_obs"))
    keys = ["window", "min_obs", "ticker", "benchmark"]
    passed = passes_at_any(per, [*keys, "signal"], min_n=F.col("min_obs"))
    at = F.col("horizon").isin(10, 20) & F.col("ic").isNotNull()
    best = per.filter(at).groupBy(*keys).agg(
        F.max_by("signal", F.struct("ic", "signal")).alias("best_signal"), F.max("ic").alias("best_ic")
    )
    verdict = passed.groupBy(*keys).agg(
        F.when(F.max("n_obs") < F.col("min_obs"), "INSUFFICIENT DATA").when(F.bool_or("passes"), "ACTIVATE").otherwise("WATCH").alias("verdict")
    )
    return per.drop("min_obs"), verdict.join(best, keys, "left").drop("min_obs")


# ---- large members ------------------------------------------------------------------

MEGACAP_WARMUP = 373


def megacap_backtest(aligned: DataFrame, min_valid: int = 6, warmup: int = MEGACAP_WARMUP) -> Evaluation:
    """Composite of aligned members: per-date IC, label means and pooled IC of each ingredient.

    Runs from row ``warmup`` to the last row with a full 20-row exit and one to spare;
    halves split at the middle row index.
    """
    series = Window.partitionBy("ticker")
    # members share their dates, so a row's position in its own series is the date's index
    staged = (
        aligned.withColumn("_i", ft.rows_seen() - 1)
        .withColumn("_n", F.count(F.lit(1)).over(series))
        .withColumns({f"_f{h}": ft.forward_return(h) for h in HORIZONS})
    )
    comp = megacap_composite(staged, label_mode="backtest", min_valid=min_valid)
    last = F.col("_n") - 22
    kept = comp.filter((F.col("_i") >= warmup) & (F.col("_i") <= last)).withColumn(
        "half", F.when(F.col("_i") < F.floor((F.lit(warmup) + last) / 2), "H1").otherwise("H2")
    )
    f = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in HORIZONS])
    obs = kept.withColumn("_f", F.explode(f)).select(
        "ticker", "date", "half", "label", "composite", "iso_rs_multi", "trend", "vol_conviction", "iso_hist_pct", "_f.horizon", "_f.fwd"
    )
    by_date = obs.select("ticker", "date", "half", "horizon", "fwd", "label", F.col("composite").alias("score"), F.lit("composite").alias("segment"))
    iso = explode_segments(
        obs.withColumn("score", F.col("composite")),
        ("rs_multi", None),
        ("trend", None),
        ("volume", None),
        ("hist_pct", None),
        score={"rs_multi": "iso_rs_multi", "trend": "trend", "volume": "vol_conviction", "hist_pct": "iso_hist_pct"},
    )
    labels = bucket_means(by_date.withColumnRenamed("label", "bucket"), ["bucket", "horizon"])
    return Evaluation(
        obs=lambda: by_date,
        date_ic=lambda: date_ic(by_date, "average", 4),
        pooled_ic=lambda: pooled_ic(iso, "average", 4),
        buckets=lambda: labels,
    )


# ---- insiders -----------------------------------------------------------------------


def insider_backtest(
    bars: DataFrame,
    trades: DataFrame,
    edges: DataFrame,
    universe: DataFrame,
    validated: Sequence[str],
    fallback_parent: str,
    start: str,
    end: str,
) -> Evaluation:
    """Insider score on every fifth trading date against next-close returns.

    Segments: all, correction (the ticker's validated parent, or the fallback, is in
    correction) and cluster (score 2). Prices run to 35 days past the end.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    px = bars.filter((F.col("date") >= lo) & (F.col("date") <= F.date_add(hi, 35))).select("ticker", "date", ft.PRICE)
    inside = bars.filter((F.col("date") >= lo) & (F.col("date") <= hi))
    dates = every_nth_date(inside, 5)
    window_trades = trades.filter((F.col("transaction_date") >= F.date_sub(lo, 35)) & (F.col("transaction_date") <= hi))
    names = (
        universe.select("ticker")
        .intersect(trades.select("ticker"))
        .intersect(bars.select("ticker"))
    )
    first_valid = (
        unique_edges(edges)
        .filter(F.col("parent").isin(*validated))
        .groupBy(F.col("child").alias("ticker"))
        .agg(F.min_by("parent", "position").alias("parent"))
    )
    grid = on_dates(names.join(first_valid, "ticker", "left").withColumn("parent", F.coalesce("parent", F.lit(fallback_parent))), dates)
    rows = grid.join(insider_score(window_trades).select("ticker", "date", "score"), ["ticker", "date"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0)).cast("double")
    )
    rows = with_parent(rows, px.withColumn("ret", ft.ret(20)), ["ret"]).withColumn("regime", regime(F.col("p_ret")))
    rows = asof_forward(rows, px, ["ticker"], "date", ft.PRICE, (1, *HORIZONS), prefix="_n")
    for h in HORIZONS:
        rows = rows.withColumn(f"_f{h}", ft.ratio(F.col(f"_n{h}") - F.col("_n1"), F.col("_n1")))
    rows = rows.filter(F.coalesce(*[F.col(f"_f{h}") for h in HORIZONS]).isNotNull())
    rows = explode_segments(rows, ("all", None), ("correction", F.col("regime") == "CORRECTION"), ("cluster", F.col("score") == 2))
    rows = with_date_half(rows, ["segment"])
    counts = rows.groupBy("segment", score_label(F.col("score")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    f = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in HORIZONS])
    long = rows.withColumn("_f", F.explode(f)).select("segment", "ticker", "date", "half", "score", "_f.horizon", "_f.fwd")
    verdict = pass_verdict(F.col("ic"), F.col("ic_h1"), F.col("ic_h2"), F.col("n"))
    pooled = lambda: pooled_ic(long, "ordinal", 5, ties=("ticker", "date"), halves=True)
    return Evaluation(obs=lambda: long, pooled_ic=lambda: pooled().withColumn("verdict", verdict), buckets=lambda: counts)


# ---- stored strength ----------------------------------------------------------------


def pair_ic(rs: DataFrame, bars: DataFrame, h: int = 5, min_rows: int = 10, threshold: float = 0.05) -> DataFrame:
    """Per stored (ticker, parent): ordinal IC of the raw strength, halves by row, and whether both pass.

    Pairs with fewer than ``min_rows`` stored or scored rows keep NULL ICs and fail.
    """
    stored = rs.filter(F.col("rs_score").isNotNull()).select("ticker", "parent", "date", F.col("rs_score").alias("score"))
    px = bars.select("ticker", "date", ft.PRICE)
    rows = asof_forward(stored, px, ["ticker"], "date", ft.PRICE, (1, h), prefix="_n")
    rows = rows.withColumn("fwd", ft.ratio(F.col(f"_n{h}") - F.col("_n1"), F.col("_n1"))).filter(F.col("fwd").isNotNull())
    rows = with_all(with_row_half(rows, ["ticker", "parent"]))
    ics = pivot_halves(
        spearman(rows, ["ticker", "parent", "half"], "ordinal", 5, ties=("date",)), ["ticker", "parent"]
    )
    size = stored.groupBy("ticker", "parent").agg(F.count(F.lit(1)).alias("n_stored"))
    out = size.join(ics, ["ticker", "parent"], "left")
    enough = (F.col("n_stored") >= min_rows) & (F.coalesce("n", F.lit(0)) >= min_rows)
    out = out.select("ticker", "parent", "n_stored", *[F.when(enough, F.col(c)).alias(c) for c in ("ic_h1", "ic_h2", "ic")])
    passed = F.coalesce((F.col("ic_h1") > threshold) & (F.col("ic_h2") > threshold), F.lit(False))
    return out.withColumnRenamed("ic", "ic_full").withColumn("passed", passed)
