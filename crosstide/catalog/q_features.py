"""Queries over per-ticker features."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog import inputs as inp
from crosstide.catalog.registry import query, r8
from crosstide.catalog.sqlparts import W, part, r8s, ret_sql, with_parts
from crosstide.operators import features as ft

C = ("ticker", "date")


@query(
    "derived_bars",
    "S-01",
    with_parts("SELECT ticker, date, ROUND(close, 8) AS close, volume FROM bars", "bars"),
)
def _(spark, d):
    from crosstide.sources.bars import load_bars

    return load_bars(inp.bars(spark, d)).select(*C, r8("close").alias("close"), "volume")


@query(
    "rolling_returns",
    "W-01 W-02",
    with_parts(
        f"SELECT ticker, date, {r8s(ret_sql(1))} AS ret_1, {r8s(ret_sql(20))} AS ret_20, {r8s(ret_sql(60))} AS ret_60 FROM bars {W}",
        "bars",
    ),
)
def _(spark, d):
    return inp.bars(spark, d).select(*C, *[r8(ft.ret(n)).alias(f"ret_{n}") for n in (1, 20, 60)])


_avg20 = "avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(
    "relative_volume",
    "W-03",
    with_parts(
        f"""SELECT ticker, date,
  {r8s(f"CASE WHEN row_number() OVER w > 20 THEN volume / {_avg20} END")} AS rvol_strict,
  {r8s(f"volume / {_avg20}")} AS rvol_lenient,
  {r8s(f"CASE WHEN row_number() OVER w > 21 THEN volume / {_avg20} END")} AS rvol_megacap,
  {r8s(f"CASE WHEN row_number() OVER w > 21 THEN volume / {_avg20} END")} AS rvol_backtest
FROM bars {W}""",
        "bars",
    ),
)
def _(spark, d):
    modes = ("strict", "lenient", "megacap", "backtest")
    return inp.bars(spark, d).select(*C, *[r8(ft.rvol(20, m)).alias(f"rvol_{m}") for m in modes])


@query(
    "relative_volume_trend",
    "W-04",
    with_parts(
        f"""SELECT ticker, date, CASE WHEN rn < 21 THEN '—' WHEN rn < 26 THEN '→'
  WHEN now > ago * 1.10::DOUBLE THEN '↑' WHEN now < ago * 0.90::DOUBLE THEN '↓' ELSE '→' END AS rvol_trend
FROM (SELECT ticker, date, row_number() OVER w AS rn, volume / {_avg20} AS now,
  lag(volume, 5) OVER w / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 25 PRECEDING AND 6 PRECEDING) AS ago
  FROM bars {W})""",
        "bars",
    ),
)
def _(spark, d):
    return inp.bars(spark, d).select(*C, ft.rvol_trend().alias("rvol_trend"))


part(
    "ma50",
    f"""
SELECT ticker, date, close, row_number() OVER w AS rn,
  row_number() OVER w > 50 AND close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS above
FROM bars {W}""",
    "bars",
)


@query("above_moving_average", "W-06", with_parts("SELECT ticker, date, above AS above_50ma FROM ma50", "ma50"))
def _(spark, d):
    return inp.bars(spark, d).select(*C, ft.above_ma(50).alias("above_50ma"))


@query(
    "days_above_moving_average",
    "W-07",
    with_parts(
        """SELECT ticker, date, least(51, rn - coalesce(max(CASE WHEN NOT above THEN rn END)
  OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0)) AS days_above FROM ma50""",
        "ma50",
    ),
)
def _(spark, d):
    return ft.with_streak(inp.bars(spark, d), cap=51).select(*C, F.col("days_above").cast("long"))


@query(
    "price_range_position",
    "W-08",
    with_parts(
        f"""SELECT ticker, date, {r8s("CASE WHEN rn >= 20 THEN (close - lo) / nullif(hi - lo, 0) * 100 END")} AS price_range_pct
FROM (SELECT ticker, date, close, row_number() OVER w AS rn,
  min(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS lo,
  max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hi FROM bars {W})""",
        "bars",
    ),
)
def _(spark, d):
    return inp.bars(spark, d).select(*C, r8(ft.range_pct()).alias("price_range_pct"))


@query(
    "realised_volatility",
    "W-09 A-05",
    with_parts(
        f"""SELECT ticker, date, {r8s("CASE WHEN rn > 20 THEN stddev_samp(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END")} AS vol_20d
FROM (SELECT ticker, date, row_number() OVER w AS rn, {ret_sql(1)} AS r FROM bars {W})""",
        "bars",
    ),
)
def _(spark, d):
    return ft.with_realized_vol(inp.bars(spark, d)).select(*C, r8("vol_20d").alias("vol_20d"))


@query(
    "history_percentile",
    "W-10",
    with_parts(
        f"""SELECT ticker, date, {r8s('''CASE WHEN rn >= 273 THEN len(list_filter(list(r) OVER (PARTITION BY ticker ORDER BY date
  ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), lambda x: x < r)) / 252.0::DOUBLE END''')} AS hist_pct_20
FROM (SELECT ticker, date, row_number() OVER w AS rn, {ret_sql(20)} AS r FROM bars {W})""",
        "bars",
    ),
)
def _(spark, d):
    return ft.with_hist_pct(inp.bars(spark, d), 20).select(*C, r8("hist_pct_20").alias("hist_pct_20"))


@query(
    "trend_structure",
    "W-11",
    with_parts(
        f"""SELECT ticker, date, CASE WHEN row_number() OVER w >= 200 THEN
  CAST(close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS INTEGER)
  + CAST(close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS INTEGER) END AS trend_raw
FROM bars {W}""",
        "bars",
    ),
)
def _(spark, d):
    return inp.bars(spark, d).select(*C, ft.trend_score().alias("trend_raw"))


@query(
    "volume_conviction",
    "W-12",
    with_parts(
        f"""SELECT ticker, date, {r8s('''CASE WHEN rn > 20 THEN sum(up) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
  / sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END''')} AS vol_conviction
FROM (SELECT ticker, date, row_number() OVER w AS rn, volume, CASE WHEN close > lag(close) OVER w THEN volume ELSE 0 END AS up FROM bars {W})""",
        "bars",
    ),
)
def _(spark, d):
    return ft.with_vol_conviction(inp.bars(spark, d)).select(*C, r8("vol_conviction").alias("vol_conviction"))


@query(
    "forward_returns",
    "W-15",
    with_parts(
        "SELECT ticker, date, "
        + ", ".join(
            f"{r8s(f'(lead(close, {h}) OVER w - lead(close, 1) OVER w) / lead(close, 1) OVER w')} AS next_{h}, "
            f"{r8s(f'(lead(close, {h}) OVER w - close) / close')} AS signal_{h}"
            for h in (1, 5, 10, 20)
        )
        + f" FROM bars {W}",
        "bars",
    ),
)
def _(spark, d):
    cols = []
    for h in (1, 5, 10, 20):
        cols += [r8(ft.forward_return(h)).alias(f"next_{h}"), r8(ft.forward_return(h, "signal_close")).alias(f"signal_{h}")]
    return inp.bars(spark, d).select(*C, *cols)


part(
    "mret",
    f"SELECT date, row_number() OVER w AS mi, {ret_sql(1)} AS m FROM market_bars {W}",
    "market_bars",
)
part("tret", f"SELECT ticker, date, row_number() OVER w AS ti, {ret_sql(1)} AS r FROM bars {W}", "bars")
part(
    "betas",
    """
SELECT a.ticker, a.date, covar_samp(t.r, m.m) / nullif(var_samp(m.m), 0) AS beta
FROM (SELECT tret.ticker, tret.date, ti, mi FROM tret ASOF JOIN mret ON tret.date >= mret.date) a
JOIN tret t ON t.ticker = a.ticker AND t.ti BETWEEN a.ti - 59 AND a.ti
JOIN mret m ON m.mi = a.mi - (a.ti - t.ti)
WHERE a.ti > 60 AND a.mi > 60 GROUP BY 1, 2 HAVING count(t.r) = 60 AND count(m.m) = 60""",
    "tret",
    "mret",
)


@query(
    "rolling_beta_by_position",
    "W-13",
    with_parts(f"SELECT b.ticker, b.date, {r8s('beta', 7)} AS beta FROM bars b LEFT JOIN betas USING (ticker, date)", "bars", "betas"),
)
def _(spark, d):
    allb = inp.series(spark, d, "nation", "market")
    own, mk = allb.filter(F.col("ticker") != inp.MARKET), allb.filter(F.col("ticker") == inp.MARKET)
    return ft.with_beta(own.select("ticker", "date", "adj_close"), mk, 60, "position").select(*C, r8("beta", 7).alias("beta"))


@query(
    "rolling_beta_by_date",
    "W-13 J-02",
    with_parts(
        f"""SELECT ticker, date, {r8s("CASE WHEN count(x) OVER f = 60 THEN covar_samp(x, y) OVER f / nullif(var_samp(y) OVER f, 0) END", 7)} AS beta
FROM (SELECT b.ticker, b.date, b.x, m.y FROM (SELECT ticker, date, {ret_sql(1)} AS x FROM bars {W}) b
  JOIN (SELECT date, {ret_sql(1)} AS y FROM region_bars WHERE ticker = 'ASIA' {W}) m USING (date) WHERE x IS NOT NULL AND y IS NOT NULL)
WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
        "bars",
        "region_bars",
    ),
)
def _(spark, d):
    allb = inp.series(spark, d, "nation", "region")
    own, mk = allb.filter(F.col("ticker").startswith("NATION")), allb.filter(F.col("ticker") == "ASIA")
    return ft.with_beta(own.select("ticker", "date", "adj_close"), mk, 60, "date").select(*C, r8("beta", 7).alias("beta"))
