"""Row-positional features of one ticker's own series.

Every function returns a Column over ``per_ticker()``; several of them in one
``select`` share a single exchange and sort. A group is one ticker's series,
unique by date, so its size is bounded by the trading calendar.
Missing inputs give NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE = "adj_close"
TRADING_DAYS = 252


def per_ticker():
    """One ticker's rows in date order."""
    return Window.partitionBy("ticker").orderBy("date")


def frame(start: int, end: int):
    return per_ticker().rowsBetween(start, end)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is NULL or zero."""
    return num / F.nullif(den, F.lit(0.0))


def rows_seen() -> Column:
    """1-based position of the row in its ticker's series."""
    return F.row_number().over(per_ticker())


def ret(n: int, price: str = PRICE) -> Column:
    """Return over the last ``n`` rows of the ticker's own series."""
    base = F.lag(price, n).over(per_ticker())
    return ratio(F.col(price) - base, base)


def rvol(n: int = 20, mode: str = "strict") -> Column:
    """Volume relative to the mean of the previous ``n`` volumes.

    strict   n previous volumes must all be present
    lenient  any number of previous rows (at least one), missing volume counts as 0
    megacap  one more row of history than strict
    backtest like megacap, missing volume counts as 0
    """
    if mode not in ("strict", "lenient", "megacap", "backtest"):
        raise ValueError(f"unknown rvol mode {mode!r}")
    zero_filled = mode in ("lenient", "backtest")
    vol = F.coalesce(F.col("volume"), F.lit(0)) if zero_filled else F.col("volume")
    vol = vol.cast("double")
    prior = frame(-n, -1)
    value = ratio(vol, F.avg(vol).over(prior))
    have = F.count(vol).over(prior)
    if mode == "strict":
        return F.when(have == n, value)
    if mode == "lenient":
        return F.when(have >= 1, value)
    return F.when(rows_seen() >= n + 2, value)


def rvol_trend(n: int = 20, back: int = 5, band: float = 0.10) -> Column:
    """Arrow comparing today's relative volume with the one ``back`` rows ago."""
    vol = F.col("volume").cast("double")
    now = ratio(vol, F.avg(vol).over(frame(-n, -1)))
    then = ratio(F.lag(vol, back).over(per_ticker()), F.avg(vol).over(frame(-n - back, -back - 1)))
    full_now = F.count(vol).over(frame(-n, 0)) == n + 1
    full_then = F.count(vol).over(frame(-n - back, 0)) == n + back + 1
    return (
        F.when(~full_now | now.isNull(), "—")
        .when(~full_then | then.isNull(), "→")
        .when(now > then * (1 + band), "↑")
        .when(now < then * (1 - band), "↓")
        .otherwise("→")
    )


def ma(n: int, include_today: bool = False, price: str = PRICE) -> Column:
    """Moving average over exactly ``n`` rows, NULL with fewer."""
    f = frame(-(n - 1), 0) if include_today else frame(-n, -1)
    return F.when(F.count(price).over(f) == n, F.avg(price).over(f))


def above_ma(n: int = 50, include_today: bool = False, price: str = PRICE) -> Column:
    """True when the close is above its moving average; False without history."""
    return F.coalesce(F.col(price) > ma(n, include_today, price), F.lit(False))


def range_pct(n: int = 20, price: str = PRICE) -> Column:
    """Position of the close between the lowest and highest of the last ``n`` closes, 0 to 100."""
    f = frame(-(n - 1), 0)
    low, high = F.min(price).over(f), F.max(price).over(f)
    return F.when(F.count(price).over(f) == n, ratio(F.col(price) - low, high - low) * 100)


def trend_score(price: str = PRICE) -> Column:
    """0, 1 or 2: above the 50-row and above the 200-row average (both including today)."""
    short, long = ma(50, True, price), ma(200, True, price)
    score = (F.col(price) > short).cast("int") + (F.col(price) > long).cast("int")
    return F.when(long.isNull(), F.lit(None).cast("int")).otherwise(score)


def with_vol_conviction(bars: DataFrame, n: int = 20, price: str = PRICE, out: str = "vol_conviction") -> DataFrame:
    """Share of the last ``n`` rows' volume that traded on up days."""
    up = F.col(price) > F.lag(price, 1).over(per_ticker())
    vol = F.coalesce(F.col("volume"), F.lit(0)).cast("double")
    f = frame(-(n - 1), 0)
    share = ratio(F.sum("_up").over(f), F.sum(vol).over(f))
    return (
        bars.withColumn("_up", F.when(up, vol).otherwise(0.0))
        .withColumn(out, F.when(rows_seen() >= n + 1, share))
        .drop("_up")
    )


def with_realized_vol(bars: DataFrame, n: int = 20, out: str = "vol_20d") -> DataFrame:
    """Annualised sample deviation of the last ``n`` one-row returns."""
    f = frame(-(n - 1), 0)
    # an undefined return (zero base) is skipped, as long as two remain
    have_prices = F.row_number().over(per_ticker()) >= n + 1
    dev = F.when(F.count("ret_1").over(f) >= 2, F.stddev_samp("ret_1").over(f))
    return (
        bars.withColumn("ret_1", ret(1))
        .withColumn(out, F.when(have_prices, dev * F.sqrt(F.lit(float(TRADING_DAYS)))))
    )


def with_streak(bars: DataFrame, n: int = 50, cap: int | None = None, out: str = "days_above") -> DataFrame:
    """Consecutive rows, today included, above the ``n``-row average, at most ``cap`` if given.

    Gaps and islands: the distance to the latest row that was not above.
    """
    flagged = bars.withColumn("_above", above_ma(n)).withColumn("_pos", rows_seen())
    last_break = F.max(F.when(~F.col("_above"), F.col("_pos"))).over(
        per_ticker().rowsBetween(Window.unboundedPreceding, 0)
    )
    streak = F.col("_pos") - F.coalesce(last_break, F.lit(0))
    return flagged.withColumn(out, streak if cap is None else F.least(F.lit(cap), streak)).drop("_above", "_pos")


def with_hist_pct(bars: DataFrame, n: int, history: int = 252, out: str | None = None) -> DataFrame:
    """Share of the previous ``history`` n-row returns strictly below today's."""
    out = out or f"hist_pct_{n}"
    past = F.collect_list("_ret").over(frame(-history, -1))
    staged = bars.withColumn("_ret", ret(n)).withColumn("_past", past).withColumn("_pos", rows_seen())
    below = F.size(F.filter("_past", lambda r: r < F.col("_ret"))).cast("double")
    share = F.when(
        (F.col("_pos") >= history + n + 1) & F.col("_ret").isNotNull() & (F.size("_past") > 0),
        below / F.nullif(F.size("_past"), F.lit(0)),
    )
    return staged.withColumn(out, share).drop("_ret", "_past", "_pos")


def with_beta(
    bars: DataFrame,
    market: DataFrame,
    n: int = 60,
    align: str = "position",
    out: str = "beta",
) -> DataFrame:
    """Rolling beta of ``n`` one-row returns against the market series.

    position  the k-th latest ticker return is paired with the k-th latest market
              return at that date, whatever their own dates (needs n+1 prices each)
    date      each side's own one-row returns, paired on the dates both have one; only
              such dates are returned

    ``market`` has columns date, adj_close (one row per trading day).
    """
    if align == "date":
        f = frame(-(n - 1), 0)
        own = bars.withColumn("_x", ret(1)).filter(F.col("_x").isNotNull())
        m = market.withColumn("ticker", F.lit("m")).select("date", ret(1).alias("_y")).filter(F.col("_y").isNotNull())
        both = own.join(m, "date")
        beta = ratio(F.covar_samp("_x", "_y").over(f), F.var_samp("_y").over(f))
        return both.withColumn(out, F.when(F.count("_x").over(f) == n, beta)).drop("_x", "_y")
    if align != "position":
        raise ValueError(f"unknown alignment {align!r}")
    from crosstide.operators.asof import asof_join

    # the market's window at the date of each ticker row, looked up once per date
    m = with_return_window(market.select(F.lit("market").alias("ticker"), "date", PRICE), n, 1)
    days = bars.select("date").distinct().withColumn("ticker", F.lit("market"))
    cols = ["rets", "sum1", "sum2", "seen"]
    spot = asof_join(days, m, ["ticker"], "date", cols, unique=True).select("date", *[F.col(c).alias("_m_" + c) for c in cols])
    own = with_return_window(bars, n, 1).select("ticker", "date", *[F.col(c).alias("_t_" + c) for c in cols])
    found = own.join(spot, "date", "left").select("ticker", "date", position_beta("_t_", "_m_", n).alias(out))
    return bars.join(found, ["ticker", "date"], "left")


def with_return_window(series: DataFrame, n: int, lookback: int) -> DataFrame:
    """(ticker, date, ret, rets, sum1, sum2, seen) of each row.

    ret is the lookback return; rets the last ``n`` one-row returns with their sum and
    sum of squares; seen the position in the series.
    """
    f = frame(-(n - 1), 0)
    return series.withColumn("_r", ret(1)).select(
        "ticker",
        "date",
        ret(lookback).alias("ret"),
        F.collect_list("_r").over(f).alias("rets"),
        F.sum("_r").over(f).alias("sum1"),
        F.sum(F.col("_r") * F.col("_r")).over(f).alias("sum2"),
        rows_seen().alias("seen"),
    )


def position_beta(x: str, y: str, n: int) -> Column:
    """cov / var of two return windows paired by position; ``x`` and ``y`` are column prefixes.

    NULL unless both sides have seen ``n`` + 1 prices and every return exists.
    """
    size = F.lit(float(n))
    products = F.zip_with(x + "rets", y + "rets", lambda a, b: a * b)
    sxy = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
    sx, sy, syy = F.col(x + "sum1"), F.col(y + "sum1"), F.col(y + "sum2")
    full = (F.col(x + "seen") > n) & (F.col(y + "seen") > n) & (F.size(x + "rets") == n) & (F.size(y + "rets") == n)
    return F.when(full, ratio(sxy - sx * sy / size, syy - sy * sy / size))


def forward_return(h: int, convention: str = "next_close", price: str = PRICE) -> Column:
    """Forward return on the ticker's own rows.

    next_close    entry at the next row, exit ``h`` rows ahead (0 for h = 1)
    signal_close  entry at this row, exit ``h`` rows ahead
    """
    exit_ = F.lead(price, h).over(per_ticker())
    if convention == "next_close":
        entry = F.lead(price, 1).over(per_ticker())
    elif convention == "signal_close":
        entry = F.col(price)
    else:
        raise ValueError(f"unknown convention {convention!r}")
    return ratio(exit_ - entry, entry)
