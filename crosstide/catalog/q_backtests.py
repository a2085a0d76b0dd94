"""Queries over evaluations: ICs, walk-forward runs and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog import inputs as inp
from crosstide.catalog.q_signals import aligned
from crosstide.catalog.registry import query, r8
from crosstide.catalog.sqlparts import W, part, r8s, ret_sql, with_parts
from crosstide.operators import features as ft
from crosstide.operators import ic as icm
from crosstide.plans import backtests as bt
from crosstide.plans import signals as sg

H = (5, 10, 20)
HV = "(VALUES (5),(10),(20)) hz(horizon)"


def ranks_sql(src: str, keys: str, rank: str, ties: str) -> str:
    """``src`` with rx, ry added within ``keys``, missing pairs removed."""
    clean = f"(SELECT * FROM {src} WHERE score IS NOT NULL AND fwd IS NOT NULL)"
    if rank == "ordinal":
        return (
            f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score, {ties}) AS rx, "
            f"row_number() OVER (PARTITION BY {keys} ORDER BY fwd, {ties}) AS ry FROM {clean})"
        )
    one = (
        "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0::DOUBLE AS {n}"
    )
    return f"(SELECT *, {one.format(k=keys, c='score', n='rx')}, {one.format(k=keys, c='fwd', n='ry')} FROM {clean})"


def ic_sql(src: str, keys: str, rank: str, min_n: int, ties: str = "date, ticker") -> str:
    return (
        f"(SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= {min_n} THEN "
        f"covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS ic FROM {ranks_sql(src, keys, rank, ties)} GROUP BY {keys})"
    )


def date_ic_sql(src: str, rank: str, min_n: int, ddof: int = 1) -> str:
    dev = "stddev_samp" if ddof else "stddev_pop"
    per = ic_sql(src, "segment, horizon, date, half", rank, min_n, "ticker")
    return f"""SELECT segment, horizon, half, n_dates, {r8s('m')} AS ic_mean, {r8s('s')} AS ic_std, {r8s('m / nullif(s, 0)', 7)} AS ic_ir
FROM (SELECT segment, horizon, half, count(ic) AS n_dates, avg(ic) AS m, CASE WHEN count(ic) >= 2 THEN {dev}(ic) END AS s
  FROM (SELECT segment, horizon, unnest(['ALL', half]) AS half, ic FROM {per}) GROUP BY ALL)"""


def pooled_sql(src: str, rank: str, min_n: int, ties: str = "date, ticker") -> str:
    return f"SELECT segment, horizon, n, {r8s('ic')} AS ic FROM {ic_sql(src, 'segment, horizon', rank, min_n, ties)}"


def halves_sql(src: str, keys: str, rank: str, min_n: int, ties: str = "date, ticker") -> str:
    both = f"(SELECT * EXCLUDE (half), unnest(['ALL', half]) AS half FROM {src})"
    pick = lambda h, c: f"max(CASE WHEN half = '{h}' THEN {c} END)"
    return (
        f"(SELECT {keys}, {pick('ALL', 'n')} AS n, {pick('ALL', 'ic')} AS ic, {pick('H1', 'ic')} AS ic_h1, {pick('H2', 'ic')} AS ic_h2 "
        f"FROM {ic_sql(both, keys + ', half', rank, min_n, ties)} GROUP BY {keys})"
    )


def half_sql(src: str, keys: str = "") -> str:
    """``src`` with the date half added."""
    on = ("USING (" + keys + ", date)") if keys else "USING (date)"
    sel = (keys + ", ") if keys else ""
    p = f"PARTITION BY {keys} " if keys else ""
    return (
        f"(SELECT * FROM {src} JOIN (SELECT {sel}date, CASE WHEN row_number() OVER ({p}ORDER BY date) - 1 < count(*) OVER ({p}) // 2 "
        f"THEN 'H1' ELSE 'H2' END AS half FROM (SELECT DISTINCT {sel}date FROM {src})) {on})"
    )


def mean_sql(src: str, keys: str) -> str:
    return f"SELECT {keys}, count(fwd) AS n, {r8s('avg(fwd)')} AS avg_fwd, {r8s('avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE WHEN fwd IS NOT NULL THEN 0.0::DOUBLE END)')} AS hit_rate FROM {src} GROUP BY {keys}"


def out_date_ic(df):
    return df.select("segment", "horizon", "half", "n_dates", r8("ic_mean").alias("ic_mean"), r8("ic_std").alias("ic_std"), r8("ic_ir", 7).alias("ic_ir"))


def out_pooled(df):
    return df.select("segment", "horizon", "n", r8("ic").alias("ic"))


def out_buckets(df, *keys):
    return df.select(*keys, "n", r8("avg_fwd").alias("avg_fwd"), r8("hit_rate").alias("hit_rate"))


# shared per-row features of evaluations
_f20 = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
part(
    "bt",
    f"""
SELECT ticker, date, close, volume, row_number() OVER w AS pos, {ret_sql(1)} AS r1, {ret_sql(20)} AS r20, volume / avg(volume) {_f20} AS rv,
  row_number() OVER w > 50 AND close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS above,
  {', '.join(f'(lead(close, {h}) OVER w - close) / close AS s{h}, (lead(close, {h}) OVER w - lead(close, 1) OVER w) / lead(close, 1) OVER w AS n{h}' for h in H)}
FROM bars {W}""",
    "bars",
)
SF = "CASE horizon WHEN 5 THEN s5 WHEN 10 THEN s10 ELSE s20 END"
NF = "CASE horizon WHEN 5 THEN n5 WHEN 10 THEN n10 ELSE n20 END"
PARENTS = "('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4')"


def parents(spark, d):
    return inp.edges(spark, d).select(F.col("parent").alias("ticker")).distinct()


# ---- plain ICs ----------------------------------------------------------------------


@query(
    "daily_ic_ordinal",
    "I-01 A-06",
    with_parts(
        f"SELECT date, n, {r8s('ic')} AS ic FROM " + ic_sql("(SELECT ticker, date, r20 AS score, n5 AS fwd FROM bt)", "date", "ordinal", 3, "ticker"),
        "bt",
    ),
)
def _(spark, d):
    obs = inp.bars(spark, d).select("ticker", "date", ft.ret(20).alias("score"), ft.forward_return(5).alias("fwd"))
    return icm.spearman(obs, ["date"], "ordinal", 3, ties=("ticker",)).select("date", "n", r8("ic").alias("ic"))


@query(
    "daily_ic_average",
    "I-01 A-06",
    with_parts(
        f"SELECT date, n, {r8s('ic')} AS ic FROM " + ic_sql("(SELECT ticker, date, above::INT AS score, n10 AS fwd FROM bt)", "date", "average", 5),
        "bt",
    ),
)
def _(spark, d):
    obs = inp.bars(spark, d).select(
        "ticker", "date", ft.above_ma(50).cast("int").alias("score"), ft.forward_return(10).alias("fwd")
    )
    return icm.spearman(obs, ["date"], "average", 5).select("date", "n", r8("ic").alias("ic"))


@query(
    "ic_summary_by_half",
    "I-02",
    with_parts(
        date_ic_sql("(SELECT 'r20' AS segment, horizon, ticker, date, half, score, fwd FROM " + half_sql(f"(SELECT ticker, date, horizon, r20 AS score, {NF} AS fwd FROM bt, {HV} WHERE r20 IS NOT NULL)") + ")", "average", 5, 0),
        "bt",
    ),
)
def _(spark, d):
    obs = icm.long_horizons(inp.bars(spark, d).select("ticker", "date", "adj_close", ft.ret(20).alias("score")), H, "next_close")
    obs = icm.with_date_half(obs.filter(F.col("score").isNotNull())).withColumn("segment", F.lit("r20"))
    return out_date_ic(bt.date_ic(obs, "average", 5, ddof=0))


@query(
    "signal_correlation",
    "A-07",
    with_parts(
        f"SELECT ticker, count(*) AS n, {r8s('covar_pop(r20, rv) / nullif(stddev_pop(r20) * stddev_pop(rv), 0)')} AS corr FROM bt WHERE r20 IS NOT NULL AND rv IS NOT NULL GROUP BY 1",
        "bt",
    ),
)
def _(spark, d):
    f = inp.bars(spark, d).select("ticker", "date", ft.ret(20).alias("a"), ft.rvol(20, "lenient").alias("b"))
    return icm.pearson(f, "a", "b", ["ticker"]).select("ticker", "n", r8("corr").alias("corr"))


@query(
    "every_fifth_date",
    "P-06",
    with_parts(
        """SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM cal)
WHERE p >= 20 AND (p - 20) % 5 = 0 QUALIFY lead(date) OVER (ORDER BY date) IS NOT NULL""",
        "cal",
    ),
)
def _(spark, d):
    return sg.every_nth_date(inp.bars(spark, d), 5, 20, drop_last=True)


# ---- walk-forward -------------------------------------------------------------------

part(
    "rebal",
    "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM cal) WHERE p >= 20 AND (p - 20) % 5 = 0 QUALIFY lead(date) OVER (ORDER BY date) IS NOT NULL",
    "cal",
)
part(
    "wf_feat",
    f"""
SELECT *, CASE WHEN idx > 20 THEN stddev_samp(r1) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END AS vol
FROM (SELECT ticker, date, close, row_number() OVER w AS idx, {ret_sql(20)} AS r20, {ret_sql(1)} AS r1 FROM bars {W})""",
    "bars",
)
part("px", "SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx, close FROM bars", "bars")
part(
    "wf_scored",
    """
SELECT c.child AS ticker, c.parent, c.date, (c.r20 - p.r20) * c.weight AS score, c.idx, c.own_date, c.vol, p.r20 AS parent_ret
FROM (SELECT g.*, f.r20, f.idx, f.vol, f.date AS own_date FROM (SELECT child, parent, weight, date FROM edges CROSS JOIN rebal) g
  ASOF JOIN wf_feat f ON f.ticker = g.child AND g.date >= f.date) c
ASOF JOIN wf_feat p ON p.ticker = c.parent AND c.date >= p.date
WHERE c.r20 IS NOT NULL AND p.r20 IS NOT NULL""",
    "wf_feat",
    "rebal",
    "edges",
)
_first = "(CASE WHEN own_date = s.date THEN s.idx ELSE s.idx + 1 END)"
part(
    "wf_obs",
    f"""
SELECT s.ticker, s.parent, s.date, s.score, s.vol AS vol_20d, s.parent_ret AS parent_ret_20d,
  (e5.close - e1.close) / e1.close AS fwd, {', '.join(f'(d{h}.close - d0.close) / d0.close AS diag_{h}' for h in (1, 5, 10, 20))},
  CASE WHEN pct >= 0.8::DOUBLE THEN 'STRONG_BUY' WHEN pct >= 0.6::DOUBLE THEN 'BUY' WHEN pct >= 0.2::DOUBLE THEN 'HOLD' ELSE 'SELL' END AS action
FROM (SELECT *, (rank() OVER (PARTITION BY date ORDER BY score) - 1) / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) AS pct FROM wf_scored) s
LEFT JOIN px e1 ON e1.ticker = s.ticker AND e1.idx = s.idx + 1 LEFT JOIN px e5 ON e5.ticker = s.ticker AND e5.idx = s.idx + 5
LEFT JOIN px d0 ON d0.ticker = s.ticker AND d0.idx = {_first}
""" + " ".join(f"LEFT JOIN px d{h} ON d{h}.ticker = s.ticker AND d{h}.idx = {_first} + {h}" for h in (1, 5, 10, 20)),
    "wf_scored",
    "px",
)


def wf(spark, d, signal="rs"):
    return bt.walk_forward_obs(inp.bars(spark, d), inp.edges(spark, d), signal, 5)


@query(
    "walk_forward_observations",
    "I-03 J-04",
    with_parts(
        f"""SELECT ticker, parent, date, action, {', '.join(f'{r8s(c)} AS {c}' for c in ('score', 'fwd', 'diag_1', 'diag_5', 'diag_10', 'diag_20', 'vol_20d', 'parent_ret_20d'))} FROM wf_obs""",
        "wf_obs",
    ),
)
def _(spark, d):
    o = wf(spark, d)
    return o.select("ticker", "parent", "date", "action", *[r8(c).alias(c) for c in ("score", "fwd", "diag_1", "diag_5", "diag_10", "diag_20", "vol_20d", "parent_ret_20d")])


part(
    "wf_period",
    """
SELECT date, coalesce(avg(fwd), 0) AS r FROM (SELECT DISTINCT date, ticker, fwd FROM (
  SELECT *, row_number() OVER (PARTITION BY parent, date ORDER BY score DESC, ticker) AS p, count(*) OVER (PARTITION BY parent, date) AS n FROM wf_obs)
  WHERE p <= greatest(1, n // 5)) GROUP BY date""",
    "wf_obs",
)
part(
    "wf_all",
    "SELECT rebal.date, coalesce(r, 0) AS r FROM rebal LEFT JOIN wf_period USING (date)",
    "rebal",
    "wf_period",
)
part(
    "wf_curve",
    "SELECT *, max(c) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, product(1 + r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM wf_all)",
    "wf_all",
)


@query(
    "walk_forward_performance",
    "I-03 I-02 W-19",
    with_parts(
        f"""WITH ics AS (SELECT count(ic) AS n_ic, avg(ic) AS m, CASE WHEN count(ic) >= 2 THEN stddev_pop(ic) END AS s
  FROM {ic_sql('wf_obs', 'date', 'average', 5)}),
perf AS (SELECT count(*) AS n_periods, coalesce(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252 / 5.0::DOUBLE), 0) AS sharpe, min((c - peak) / peak) AS dd FROM wf_curve)
SELECT n_periods, {r8s('sharpe', 7)} AS sharpe, {r8s('dd', 7)} AS max_drawdown, n_ic, {r8s('coalesce(m, 0)')} AS ic_mean,
  {r8s('coalesce(s, 0)')} AS ic_std, {r8s('coalesce(m / nullif(s, 0), 0)', 7)} AS ic_ir FROM perf, ics""",
        "wf_obs",
        "wf_curve",
    ),
)
def _(spark, d):
    o = bt.walk_forward(inp.bars(spark, d), inp.edges(spark, d), "rs", 5)
    return o.select(
        "n_periods", r8("sharpe", 7).alias("sharpe"), r8("max_drawdown", 7).alias("max_drawdown"), "n_ic",
        r8("ic_mean").alias("ic_mean"), r8("ic_std").alias("ic_std"), r8("ic_ir", 7).alias("ic_ir"),
    )


@query(
    "drawdown_curve",
    "W-19 T-02",
    with_parts(
        f"SELECT date, {r8s('r')} AS period_return, {r8s('ln(c)')} AS log_growth, {r8s('(c - peak) / peak', 7)} AS drawdown FROM wf_curve",
        "wf_curve",
    ),
)
def _(spark, d):
    b = inp.bars(spark, d)
    rets = bt.period_returns(wf(spark, d), sg.every_nth_date(b, 5, 20, drop_last=True))
    c = bt.drawdown_curve(rets)
    return c.select("date", r8("period_return").alias("period_return"), r8(F.log("cumulative")).alias("log_growth"), r8("drawdown", 7).alias("drawdown"))


part(
    "wf_quint",
    """
SELECT a.action, coalesce(q.n, 0) AS count, d1, d5, d10, d20, hit, vol FROM (VALUES ('STRONG_BUY'),('BUY'),('HOLD'),('SELL')) a(action)
LEFT JOIN (SELECT action, count(*) AS n, avg(diag_1) AS d1, avg(diag_5) AS d5, avg(diag_10) AS d10, avg(diag_20) AS d20,
  avg((fwd > 0)::INT) AS hit, avg(vol_20d) AS vol FROM wf_obs GROUP BY 1) q USING (action)""",
    "wf_obs",
)


@query(
    "quintile_calibration",
    "I-04 A-03",
    with_parts(
        f"SELECT action, count, {r8s('d1')} AS avg_fwd_1d, {r8s('d5')} AS avg_fwd_5d, {r8s('d10')} AS avg_fwd_10d, {r8s('d20')} AS avg_fwd_20d, {r8s('hit')} AS hit_rate, {r8s('vol')} AS avg_vol_20d FROM wf_quint",
        "wf_quint",
    ),
)
def _(spark, d):
    q = bt.quintile_stats(wf(spark, d))
    names = [c for c in q.columns if c not in ("action", "count")]
    return q.select("action", "count", *[r8(c).alias(c) for c in names])


@query(
    "risk_flag",
    "I-21",
    with_parts(
        f"""SELECT {r8s('x')} AS vol_ratio, coalesce(x >= 2, FALSE) AS flagged FROM (SELECT max(CASE WHEN action = 'STRONG_BUY' THEN vol END) / max(CASE WHEN action = 'HOLD' THEN vol END) AS x FROM wf_quint)""",
        "wf_quint",
    ),
)
def _(spark, d):
    f = bt.vol_ratio_flag(bt.quintile_stats(wf(spark, d)))
    return f.select(r8("vol_ratio").alias("vol_ratio"), "flagged")


@query(
    "walk_forward_split",
    "I-03 I-05",
    with_parts(
        """SELECT count(*) AS n_dates, CASE WHEN count(*) >= 4 THEN min(date) END AS start_date,
  CASE WHEN count(*) >= 4 THEN min(date) FILTER (pos >= n // 2) END AS mid_date, CASE WHEN count(*) >= 4 THEN max(date) END AS end_date
FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM wf_obs))""",
        "wf_obs",
    ),
)
def _(spark, d):
    return bt.split_dates(wf(spark, d))


_BR = "CASE WHEN parent_ret_20d > 0 THEN 'strong' WHEN parent_ret_20d >= -0.05::DOUBLE THEN 'mild' WHEN parent_ret_20d >= -0.15::DOUBLE THEN 'correction' WHEN parent_ret_20d IS NOT NULL THEN 'drawdown' END"


@query(
    "segment_information_coefficients",
    "I-05 A-10",
    with_parts(
        f"""WITH h AS {half_sql('wf_obs')},
s AS (SELECT date, ticker, score, fwd, 'parent' AS kind, parent AS segment, 'ALL' AS half FROM h
 UNION ALL SELECT date, ticker, score, fwd, 'direction', CASE WHEN parent_ret_20d > 0 THEN 'strong' ELSE 'weak' END, 'ALL' FROM h
 UNION ALL SELECT date, ticker, score, fwd, 'regime', {_BR}, unnest(['ALL', half]) FROM h)
SELECT kind, segment, half, n, {r8s('ic')} AS ic FROM {ic_sql('s', 'kind, segment, half', 'average', 1)}
WHERE ic IS NOT NULL AND n >= CASE WHEN half = 'ALL' THEN 5 ELSE 20 END""",
        "wf_obs",
    ),
)
def _(spark, d):
    s = bt.segment_ic(wf(spark, d))
    return s.select("kind", "segment", "half", "n", r8("ic").alias("ic"))


# ---- relative volume ----------------------------------------------------------------

part(
    "rv_obs",
    half_sql(
        f"(SELECT ticker, date, horizon, rv, sign(r1)::DOUBLE AS dir, ticker IN {PARENTS} AS m, {SF} AS fwd FROM bt, {HV} WHERE pos > 21 AND r1 IS NOT NULL)"
    )[1:-1],
    "bt",
)


def rvol(spark, d):
    return bt.rvol_backtest(inp.bars(spark, d), parents(spark, d))


@query(
    "volume_backtest_daily",
    "I-06",
    with_parts(date_ic_sql("(SELECT 'all' AS segment, horizon, ticker, date, half, rv * dir AS score, fwd FROM rv_obs)", "ordinal", 3), "rv_obs"),
)
def _(spark, d):
    return out_date_ic(rvol(spark, d).date_ic)


@query(
    "volume_backtest_pooled",
    "I-06 I-01",
    with_parts(
        pooled_sql(
            """(SELECT 'unsigned' AS segment, horizon, ticker, date, rv AS score, fwd FROM rv_obs
 UNION ALL SELECT 'direction', horizon, ticker, date, dir, fwd FROM rv_obs
 UNION ALL SELECT CASE WHEN m THEN 'megacap' ELSE 'dependent' END, horizon, ticker, date, rv * dir, fwd FROM rv_obs)""",
            "ordinal",
            3,
        ),
        "rv_obs",
    ),
)
def _(spark, d):
    return out_pooled(rvol(spark, d).pooled_ic)


@query(
    "volume_backtest_high_volume",
    "I-06 A-03",
    with_parts(
        mean_sql("(SELECT CASE WHEN dir > 0 THEN 'up_high_rvol' ELSE 'down_high_rvol' END AS bucket, horizon, fwd FROM rv_obs WHERE rv >= 2 AND dir <> 0)", "bucket, horizon"),
        "rv_obs",
    ),
)
def _(spark, d):
    return out_buckets(rvol(spark, d).buckets, "bucket", "horizon")


def coverage_sql(obs: str, scored: str, min_dates: int = 0) -> str:
    """Dates, halves and observations at five rows of ``obs``; ``scored`` is its (date, ticker, score, fwd) at that horizon."""
    return f"""WITH days AS (SELECT DISTINCT date, half FROM {obs}),
o AS (SELECT coalesce(sum(CASE WHEN ic IS NOT NULL THEN n END), 0)::BIGINT AS n_obs FROM {ic_sql(scored, 'date', 'ordinal', 3, 'ticker')})
SELECT count(*) AS n_dates, min(date) AS start_date, max(date) AS end_date, min(CASE WHEN half = 'H2' THEN date END) AS mid_date,
 count(CASE WHEN half = 'H1' THEN 1 END) AS n_h1, count(CASE WHEN half = 'H2' THEN 1 END) AS n_h2, max(n_obs) AS n_obs, max(n_obs) >= 100 AND count(*) >= {min_dates} AS sufficient FROM days, o"""


@query(
    "volume_backtest_coverage",
    "I-06",
    with_parts(
        f"""WITH days AS (SELECT DISTINCT date, half FROM rv_obs),
o AS (SELECT coalesce(sum(CASE WHEN ic IS NOT NULL THEN n END), 0)::BIGINT AS n_obs FROM {ic_sql("(SELECT date, ticker, rv * dir AS score, fwd FROM rv_obs WHERE horizon = 5)", 'date', 'ordinal', 3, 'ticker')})
SELECT count(*) AS n_dates, min(date) AS start_date, max(date) AS end_date, min(CASE WHEN half = 'H2' THEN date END) AS mid_date,
 count(CASE WHEN half = 'H1' THEN 1 END) AS n_h1, count(CASE WHEN half = 'H2' THEN 1 END) AS n_h2, max(n_obs) AS n_obs, max(n_obs) >= 100 AS sufficient FROM days, o""",
        "rv_obs",
    ),
)
def _(spark, d):
    return bt.coverage(rvol(spark, d).obs, "ordinal", 3)


# ---- estimates ----------------------------------------------------------------------

part(
    "est_obs",
    half_sql(
        f"""(SELECT s.ticker, s.date, horizon, score, CASE horizon WHEN 5 THEN (x5.close - s.close) / s.close WHEN 10 THEN (x10.close - s.close) / s.close ELSE (x20.close - s.close) / s.close END AS fwd
FROM (SELECT e.ticker, e.date, e.score, f.idx, f.close FROM (SELECT ticker, date, (analysts_up - analysts_down) / (analysts_up + analysts_down)::DOUBLE AS score FROM estimates WHERE analysts_up + analysts_down > 0) e
  ASOF LEFT JOIN wf_feat f ON f.ticker = e.ticker AND e.date >= f.date) s
LEFT JOIN px x5 ON x5.ticker = s.ticker AND x5.idx = s.idx + 5 LEFT JOIN px x10 ON x10.ticker = s.ticker AND x10.idx = s.idx + 10
LEFT JOIN px x20 ON x20.ticker = s.ticker AND x20.idx = s.idx + 20, {HV})"""
    )[1:-1],
    "estimates",
    "wf_feat",
    "px",
)


def est(spark, d):
    from crosstide.sources.tables import revision_score

    return bt.estimates_backtest(revision_score(inp.estimates(spark, d)), inp.bars(spark, d))


@query(
    "revision_backtest_coverage",
    "I-07",
    with_parts(coverage_sql("est_obs", "(SELECT date, ticker, score, fwd FROM est_obs WHERE horizon = 5)", 20), "est_obs"),
)
def _(spark, d):
    return bt.coverage(est(spark, d).obs, "ordinal", 3, min_dates=20)


@query(
    "revision_backtest_daily",
    "I-07 S-14",
    with_parts(date_ic_sql("(SELECT 'all' AS segment, * FROM est_obs)", "ordinal", 3), "est_obs"),
)
def _(spark, d):
    return out_date_ic(est(spark, d).date_ic)


@query(
    "revision_backtest_spread",
    "I-07",
    with_parts(
        mean_sql("(SELECT CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS bucket, horizon, fwd FROM est_obs WHERE score <> 0)", "bucket, horizon"),
        "est_obs",
    ),
)
def _(spark, d):
    return out_buckets(est(spark, d).buckets, "bucket", "horizon")


# ---- confirmation -------------------------------------------------------------------

part(
    "buy_days",
    """
SELECT DISTINCT ticker, unnest(generate_series(filed_date, transaction_date + 30, INTERVAL 1 DAY))::DATE AS date
FROM trades WHERE transaction_code = 'P' AND is_open_market AND filed_date <= transaction_date + 30""",
    "trades",
)
part(
    "cf_feat",
    """
SELECT bt.*, b.ticker IS NOT NULL AS insider FROM bt LEFT JOIN buy_days b ON b.ticker = bt.ticker AND b.date = bt.date
WHERE pos > 51 AND coalesce(s5, s10, s20) IS NOT NULL""",
    "bt",
    "buy_days",
)
_SCORE = "(rs_pos::INT + (rv >= 1.5::DOUBLE)::INT + insider::INT + above::INT)::DOUBLE"
_BUCKET = "CASE WHEN score <= 1 THEN '0-1' WHEN score = 2 THEN '2' ELSE '3-4' END"
part("bench20", f"SELECT date, {ret_sql(20)} AS b FROM region_bars WHERE ticker = 'ASIA' {W}", "region_bars")
part(
    "cf_obs",
    half_sql(
        f"""(SELECT *, {_SCORE} AS score, rs_pos::INT::DOUBLE AS rs_only FROM (SELECT c.ticker, c.date, horizon, {SF} AS fwd, rv, insider, above, c.ticker IN {PARENTS} AS m,
  coalesce(CASE WHEN c.ticker IN {PARENTS} THEN r20 - b.b > 0 ELSE r20 > 0 END, FALSE) AS rs_pos FROM (SELECT * FROM cf_feat) c ASOF LEFT JOIN bench20 b ON c.date >= b.date, {HV}))"""
    )[1:-1],
    "cf_feat",
    "bench20",
)


def confirm(spark, d):
    allb = inp.series(spark, d, "nation", "region")
    own = allb.filter(F.col("ticker").startswith("NATION"))
    bench = allb.filter(F.col("ticker") == "ASIA")
    return bt.confirmation_backtest(own, inp.trades(spark, d), parents(spark, d), bench)


@query(
    "insider_buy_days",
    "J-06",
    with_parts("SELECT ticker, date FROM buy_days", "buy_days"),
)
def _(spark, d):
    from crosstide.plans.insiders import insider_buy_days

    return insider_buy_days(inp.trades(spark, d))


@query(
    "confirmation_scores",
    "G-10",
    with_parts("SELECT DISTINCT ticker, date, score::INT AS score, half FROM cf_obs", "cf_obs"),
)
def _(spark, d):
    return confirm(spark, d).obs.select("ticker", "date", F.col("score").cast("int").alias("score"), "half").distinct()


@query(
    "confirmation_backtest_coverage",
    "I-08",
    with_parts(coverage_sql("cf_obs", "(SELECT date, ticker, score, fwd FROM cf_obs WHERE horizon = 5)"), "cf_obs"),
)
def _(spark, d):
    return bt.coverage(confirm(spark, d).obs, "ordinal", 3)


@query(
    "confirmation_backtest_daily",
    "I-08",
    with_parts(date_ic_sql("(SELECT 'all' AS segment, * FROM cf_obs)", "ordinal", 3), "cf_obs"),
)
def _(spark, d):
    return out_date_ic(confirm(spark, d).date_ic)


@query(
    "confirmation_backtest_pooled",
    "I-08",
    with_parts(
        pooled_sql(
            """(SELECT CASE WHEN m THEN 'megacap' ELSE 'dependent' END AS segment, horizon, ticker, date, score, fwd FROM cf_obs
 UNION ALL SELECT 'rs_only', horizon, ticker, date, rs_only, fwd FROM cf_obs UNION ALL SELECT 'score', horizon, ticker, date, score, fwd FROM cf_obs)""",
            "ordinal",
            3,
        ),
        "cf_obs",
    ),
)
def _(spark, d):
    return out_pooled(confirm(spark, d).pooled_ic)


@query(
    "confirmation_backtest_buckets",
    "I-08 A-03",
    with_parts(mean_sql(f"(SELECT {_BUCKET} AS bucket, horizon, fwd FROM cf_obs)", "bucket, horizon"), "cf_obs"),
)
def _(spark, d):
    return out_buckets(confirm(spark, d).buckets, "bucket", "horizon")


part(
    "falling",
    f"SELECT ticker AS parent, date, r20 AS p_ret FROM bt WHERE ticker IN {PARENTS} AND r20 >= -0.15::DOUBLE AND r20 < -0.05::DOUBLE",
    "bt",
)
part(
    "qual",
    "SELECT child AS ticker, date, avg(p_ret) AS parent_mean, count(*) AS n_parents, bool_or(parent IN ('NATION_0','NATION_1','NATION_2')) AS is_validated FROM edges JOIN falling USING (parent) GROUP BY 1, 2",
    "edges",
    "falling",
)


@query(
    "qualifying_parents",
    "J-14",
    with_parts(f"SELECT ticker, date, {r8s('parent_mean')} AS parent_mean, n_parents, is_validated FROM qual", "qual"),
)
def _(spark, d):
    q = bt.qualifying_parents(inp.bars(spark, d), inp.edges(spark, d), parents(spark, d), inp.VALIDATED)
    return q.select("ticker", "date", r8("parent_mean").alias("parent_mean"), "n_parents", "is_validated")


part(
    "cr_obs",
    half_sql(
        f"""(SELECT *, {_SCORE} AS score, rs_pos::INT::DOUBLE AS rs_only FROM (SELECT c.ticker, c.date, horizon, {SF} AS fwd, rv, insider, above, is_validated,
  coalesce(r20 > 0, FALSE) AS rs_pos FROM cf_feat c JOIN qual q ON q.ticker = c.ticker AND q.date = c.date, {HV} WHERE c.ticker NOT IN {PARENTS}))"""
    )[1:-1],
    "cf_feat",
    "qual",
)
_CRSEG = "(SELECT * EXCLUDE (seg), unnest(CASE WHEN is_validated THEN ['all', 'validated'] ELSE ['all'] END) AS segment FROM (SELECT *, 0 AS seg FROM cr_obs))"


def confirm_regime(spark, d):
    return bt.confirmation_regime_backtest(
        inp.bars(spark, d), inp.trades(spark, d), inp.edges(spark, d), parents(spark, d), inp.VALIDATED
    )


@query(
    "correction_backtest_daily",
    "I-09",
    with_parts(date_ic_sql(_CRSEG, "ordinal", 3), "cr_obs"),
)
def _(spark, d):
    return out_date_ic(confirm_regime(spark, d).date_ic)


@query(
    "correction_backtest_pooled",
    "I-09",
    with_parts(
        pooled_sql(
            f"(SELECT segment, horizon, ticker, date, score, fwd FROM {_CRSEG} UNION ALL SELECT segment || '_rs_only', horizon, ticker, date, rs_only, fwd FROM {_CRSEG})",
            "ordinal",
            3,
        ),
        "cr_obs",
    ),
)
def _(spark, d):
    return out_pooled(confirm_regime(spark, d).pooled_ic)


@query(
    "correction_backtest_buckets",
    "I-09",
    with_parts(mean_sql(f"(SELECT segment, {_BUCKET} AS bucket, horizon, fwd FROM {_CRSEG})", "segment, bucket, horizon"), "cr_obs"),
)
def _(spark, d):
    return out_buckets(confirm_regime(spark, d).buckets, "segment", "bucket", "horizon")


# ---- rotation -----------------------------------------------------------------------

part(
    "rotation61",
    "SELECT r.date, r.focus_rank <= 2 AS is_lead FROM rotation r JOIN (SELECT g.date, min(f.seen) AS seen FROM (SELECT date, ticker FROM cal CROSS JOIN (VALUES ('AFRICA'),('AMERICA'),('ASIA'),('EUROPE')) s(ticker)) g ASOF LEFT JOIN rot_feat f ON f.ticker = g.ticker AND g.date >= f.date GROUP BY 1 HAVING count(f.seen) = 4 AND min(f.seen) >= 61) USING (date)",
    "rotation",
    "rot_feat",
)
part(
    "qualv",
    "SELECT child AS ticker, date, avg(p_ret) AS parent_mean FROM edges JOIN falling USING (parent) WHERE parent IN ('NATION_0','NATION_1','NATION_2') GROUP BY 1, 2",
    "edges",
    "falling",
)
part(
    "rot_obs",
    half_sql(
        f"""(SELECT c.ticker, c.date, horizon, {SF} AS fwd, r20 - parent_mean AS score, is_lead FROM bt c JOIN qualv q ON q.ticker = c.ticker AND q.date = c.date
  LEFT JOIN rotation61 r ON r.date = c.date, {HV} WHERE pos > 51 AND c.ticker NOT IN {PARENTS} AND coalesce(s5, s10, s20) IS NOT NULL)"""
    )[1:-1],
    "bt",
    "qualv",
    "rotation61",
)
part(
    "rot_seg",
    "SELECT * EXCLUDE (is_lead), unnest(CASE WHEN is_lead THEN ['baseline', 'LEADING'] WHEN NOT is_lead THEN ['baseline', 'not-LEADING'] ELSE ['baseline'] END) AS segment FROM rot_obs WHERE fwd IS NOT NULL",
    "rot_obs",
)
part("rot_ic", f"SELECT * FROM {halves_sql('rot_seg', 'segment, horizon', 'ordinal', 3)}", "rot_seg")


def rotation(spark, d):
    allb = inp.series(spark, d, "nation", "region", "market")
    own = allb.filter(F.col("ticker").startswith("NATION"))
    valid = spark.createDataFrame([(v,) for v in inp.VALIDATED], "ticker string")
    return bt.rotation_backtest(
        own, allb, inp.edges(spark, d), valid, parents(spark, d), inp.SECTORS, inp.FOCUS_SECTOR, inp.MARKET
    )


@query(
    "rotation_backtest",
    "I-10",
    with_parts(
        f"""SELECT p.segment, p.horizon, n, {r8s('ic')} AS ic, {r8s('ic_h1')} AS ic_h1, {r8s('ic_h2')} AS ic_h2, {r8s('ic / nullif(sd, 0)', 7)} AS ir_proxy,
  max(CASE WHEN p.horizon = 5 THEN CASE WHEN n >= 100 THEN 'OK' WHEN n >= 50 THEN 'MARGINAL' ELSE 'INSUFFICIENT' END END) OVER (PARTITION BY p.segment) AS sufficiency
FROM rot_ic p JOIN (SELECT segment, horizon, stddev_samp(fwd) AS sd FROM rot_seg GROUP BY 1, 2) USING (segment, horizon)""",
        "rot_ic",
    ),
)
def _(spark, d):
    p = rotation(spark, d).pooled_ic
    return p.select("segment", "horizon", "n", r8("ic").alias("ic"), r8("ic_h1").alias("ic_h1"), r8("ic_h2").alias("ic_h2"), r8("ir_proxy", 7).alias("ir_proxy"), "sufficiency")


@query(
    "rotation_verdicts",
    "I-22 I-17",
    with_parts(
        f"""SELECT segment, horizon, CASE WHEN ic > 0.05::DOUBLE AND ic_h1 > 0 AND ic_h2 > 0 THEN 'PASS' WHEN ic > 0 AND ic_h1 > 0 AND ic_h2 > 0 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict,
 {r8s("ic - max(CASE WHEN segment = 'baseline' THEN ic END) OVER (PARTITION BY horizon)")} AS delta FROM rot_ic""",
        "rot_ic",
    ),
)
def _(spark, d):
    p = rotation(spark, d).pooled_ic
    base = p.filter("segment = 'baseline'").select("horizon", F.col("ic").alias("_b"))
    return p.join(base, "horizon", "left").select(
        "segment",
        "horizon",
        bt.three_way_verdict(F.col("ic"), F.col("ic_h1"), F.col("ic_h2")).alias("verdict"),
        r8(F.col("ic") - F.col("_b")).alias("delta"),
    )


# ---- baskets and themes -------------------------------------------------------------

SINCE = "1998-01-01"
part(
    "zb",
    f"""
SELECT theme, ticker, pos, date, z, z * rv AS combined, horizon, fwd FROM (
  SELECT t.theme, b.ticker, t.p AS pos, b.date, CASE WHEN count(r20) OVER g >= 3 THEN (r20 - avg(r20) OVER g) / nullif(stddev_pop(r20) OVER g, 0) END AS z, rv, s5, s10, s20
  FROM bt b JOIN (SELECT theme, ticker, CAST(substr(ticker, 8) AS BIGINT) AS p FROM themes) t ON t.ticker = b.ticker WINDOW g AS (PARTITION BY theme, date)) q, LATERAL (SELECT horizon, {SF} AS fwd FROM {HV}) h
WHERE z IS NOT NULL""",
    "bt",
    "themes",
)
part(
    "zb_obs",
    f"""
SELECT theme || '/' || win || '/' || sig AS segment, ticker, pos, date, half, horizon, fwd, CASE sig WHEN 'z' THEN z ELSE combined END AS score
FROM {half_sql(f"(SELECT *, unnest(CASE WHEN date >= DATE '{SINCE}' THEN ['full', 'since'] ELSE ['full'] END) AS win FROM zb)", 'theme, win')}, (VALUES ('z'), ('z_rvol')) s(sig)""",
    "zb",
)


@query(
    "basket_backtest",
    "I-11",
    with_parts(
        f"SELECT segment, horizon, n, {r8s('ic')} AS ic, {r8s('ic_h1')} AS ic_h1, {r8s('ic_h2')} AS ic_h2 FROM {halves_sql('zb_obs', 'segment, horizon', 'ordinal', 3, 'date, pos')}",
        "zb_obs",
    ),
)
def _(spark, d):
    basket = inp.themes(spark, d).select("theme", "ticker", F.substring("ticker", 8, 9).cast("long").alias("position"))
    p = bt.zscore_backtest(inp.bars(spark, d), basket, SINCE).pooled_ic
    return p.select("segment", "horizon", "n", r8("ic").alias("ic"), r8("ic_h1").alias("ic_h1"), r8("ic_h2").alias("ic_h2"))


part(
    "th_rows",
    f"""
SELECT * FROM (SELECT a.ticker, t.benchmark, a.date, a.r20 - b.r AS score, n5, n10, n20,
  row_number() OVER (PARTITION BY a.ticker, t.benchmark ORDER BY a.date) AS p, count(*) OVER (PARTITION BY a.ticker, t.benchmark) AS len
  FROM bt a JOIN themes t ON t.ticker = a.ticker JOIN nr20 b ON b.ticker = t.benchmark AND b.date = a.date)
WHERE p > 20 AND p <= greatest(20, len - 20) AND score IS NOT NULL AND coalesce(n5, n10, n20) IS NOT NULL""",
    "bt",
    "themes",
    "nr20",
)
part(
    "th_long",
    f"""
SELECT ticker, benchmark, date, score, horizon, {NF} AS fwd, CASE WHEN row_number() OVER (PARTITION BY ticker, benchmark, horizon ORDER BY date) - 1 < count(*) OVER (PARTITION BY ticker, benchmark, horizon) // 2 THEN 'H1' ELSE 'H2' END AS half,
  count(*) OVER (PARTITION BY ticker, benchmark, horizon) AS n_obs FROM th_rows, {HV}""",
    "th_rows",
)
part(
    "th_ic",
    f"""
SELECT k.ticker, k.benchmark, k.horizon, k.n_obs, {', '.join(f'CASE WHEN k.n_obs >= 30 THEN {c} END AS {c}' for c in ('ic', 'ic_h1', 'ic_h2'))}
FROM (SELECT DISTINCT ticker, benchmark, horizon, n_obs FROM th_long) k LEFT JOIN {halves_sql('th_long', 'ticker, benchmark, horizon', 'average', 5)} i USING (ticker, benchmark, horizon)""",
    "th_long",
)


def theme(spark, d):
    return bt.theme_backtest(inp.series(spark, d, "nation", "region"), inp.themes(spark, d))


@query(
    "theme_backtest",
    "I-12 J-02",
    with_parts(f"SELECT ticker, benchmark, horizon, n_obs, {r8s('ic')} AS ic, {r8s('ic_h1')} AS ic_h1, {r8s('ic_h2')} AS ic_h2 FROM th_ic", "th_ic"),
)
def _(spark, d):
    p = theme(spark, d).per_ticker
    return p.select("ticker", "benchmark", "horizon", "n_obs", r8("ic").alias("ic"), r8("ic_h1").alias("ic_h1"), r8("ic_h2").alias("ic_h2"))


_PASS = "coalesce(bool_or(horizon IN (10, 20) AND ic > 0.05::DOUBLE AND ic_h1 > 0 AND ic_h2 > 0), FALSE)"


@query(
    "theme_verdicts",
    "I-12 I-17",
    with_parts(f"SELECT ticker, benchmark, max(n_obs) AS n_obs, {_PASS} AND max(n_obs) >= 30 AS passes FROM th_ic GROUP BY 1, 2", "th_ic"),
)
def _(spark, d):
    return theme(spark, d).verdicts


@query(
    "theme_backtest_combined",
    "I-12",
    with_parts(pooled_sql("(SELECT 'combined' AS segment, ticker, date, score, horizon, fwd FROM th_long)", "average", 5), "th_long"),
)
def _(spark, d):
    return out_pooled(theme(spark, d).combined)


def ct_parts(p: str, since: str, n: int) -> None:
    """ICs of one catalyst window: a condition on its dates and the fewest observations."""

    part(
        f"{p}_rows",
        f"""
    SELECT ticker, benchmark, date, n5, n10, n20, sig AS signal, CASE sig WHEN 'rvol' THEN rv WHEN 'rs_vs_broad' THEN r20 - x ELSE r20 - b END AS score
    FROM (SELECT q.*, m.m AS x FROM (SELECT o.*, b.r AS b FROM (SELECT a.ticker, t.benchmark, a.date, a.r20, CASE WHEN a.pos > 20 THEN a.rv END AS rv, n5, n10, n20,
        row_number() OVER (PARTITION BY a.ticker ORDER BY a.date) AS p, count(*) OVER (PARTITION BY a.ticker) AS len
        FROM bt a JOIN themes t ON t.ticker = a.ticker {since}) o
      ASOF LEFT JOIN nr20 b ON b.ticker = o.benchmark AND o.date >= b.date) q ASOF LEFT JOIN mr20 m ON q.date >= m.date WHERE p <= len - 20), (VALUES ('rvol'), ('rs_vs_broad'), ('rs_vs_benchmark')) s(sig)
    WHERE coalesce(n5, n10, n20) IS NOT NULL""",
        "bt",
        "themes",
        "nr20",
        "mr20",
    )
    part(
        f"{p}_long",
        f"""
    SELECT *, {NF} AS fwd, CASE WHEN row_number() OVER (PARTITION BY ticker, benchmark, signal, horizon ORDER BY date) - 1 < count(*) OVER (PARTITION BY ticker, benchmark, signal, horizon) // 2 THEN 'H1' ELSE 'H2' END AS half,
      count(*) OVER (PARTITION BY ticker, benchmark, signal, horizon) AS n_obs FROM {p}_rows, {HV} WHERE score IS NOT NULL""",
        f"{p}_rows",
    )
    part(
        f"{p}_ic",
        f"""
    SELECT k.ticker, k.benchmark, k.signal, k.horizon, k.n_obs, {', '.join(f'CASE WHEN k.n_obs >= {n} THEN {c} END AS {c}' for c in ('ic', 'ic_h1', 'ic_h2'))}
    FROM (SELECT DISTINCT ticker, benchmark, signal, horizon, n_obs FROM {p}_long) k LEFT JOIN {halves_sql(f'{p}_long', 'ticker, benchmark, signal, horizon', 'average', 5)} i USING (ticker, benchmark, signal, horizon)""",
        f"{p}_long",
    )


ct_parts("ct", "WHERE a.date >= DATE '1998-01-01'", 30)
ct_parts("cf", "", 100)


def catalyst(spark, d):
    return bt.catalyst_backtest(inp.series(spark, d, "nation", "region", "market"), inp.themes(spark, d), inp.MARKET, "1998-01-01", 30)


@query(
    "catalyst_backtest",
    "I-13",
    with_parts(f"SELECT ticker, benchmark, signal, horizon, n_obs, {r8s('ic')} AS ic, {r8s('ic_h1')} AS ic_h1, {r8s('ic_h2')} AS ic_h2 FROM ct_ic", "ct_ic"),
)
def _(spark, d):
    p = catalyst(spark, d)[0]
    return p.select("ticker", "benchmark", "signal", "horizon", "n_obs", r8("ic").alias("ic"), r8("ic_h1").alias("ic_h1"), r8("ic_h2").alias("ic_h2"))


def ct_verdict_sql(t: str, n: int) -> str:
    return f"""WITH p AS (SELECT ticker, benchmark, signal, max(n_obs) AS n_obs, {_PASS} AND max(n_obs) >= {n} AS passes FROM {t} GROUP BY 1, 2, 3),
b AS (SELECT ticker, benchmark, signal AS best_signal, {r8s('ic')} AS best_ic FROM {t} WHERE horizon IN (10, 20) AND ic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, benchmark ORDER BY {t}.ic DESC, signal DESC) = 1)
SELECT v.ticker, v.benchmark, verdict, best_signal, best_ic FROM (SELECT ticker, benchmark, CASE WHEN max(n_obs) < {n} THEN 'INSUFFICIENT DATA' WHEN bool_or(passes) THEN 'ACTIVATE' ELSE 'WATCH' END AS verdict FROM p GROUP BY 1, 2) v LEFT JOIN b USING (ticker, benchmark)"""


@query("catalyst_verdicts", "I-13 I-17", with_parts(ct_verdict_sql("ct_ic", 30), "ct_ic"))
def _(spark, d):
    v = catalyst(spark, d)[1]
    return v.select("ticker", "benchmark", "verdict", "best_signal", r8("best_ic").alias("best_ic"))


def ct_windows(spark, d):
    b = inp.series(spark, d, "nation", "region", "market")
    return bt.catalyst_windows(b, inp.themes(spark, d), inp.MARKET, [("full", None, 100), ("recent", "1998-01-01", 30)])


_CT_COLS = f"ticker, benchmark, signal, horizon, n_obs, {r8s('ic')} AS ic, {r8s('ic_h1')} AS ic_h1, {r8s('ic_h2')} AS ic_h2"


@query(
    "catalyst_windows",
    "I-13",
    with_parts(f"SELECT 'full' AS \"window\", {_CT_COLS} FROM cf_ic UNION ALL SELECT 'recent', {_CT_COLS} FROM ct_ic", "ct_ic", "cf_ic"),
)
def _(spark, d):
    p = ct_windows(spark, d)[0]
    return p.select("window", "ticker", "benchmark", "signal", "horizon", "n_obs", r8("ic").alias("ic"), r8("ic_h1").alias("ic_h1"), r8("ic_h2").alias("ic_h2"))


@query(
    "catalyst_window_verdicts",
    "I-13 I-17",
    with_parts(
        f"SELECT 'full' AS \"window\", * FROM ({ct_verdict_sql('cf_ic', 100)}) UNION ALL SELECT 'recent', * FROM ({ct_verdict_sql('ct_ic', 30)})", "ct_ic", "cf_ic"
    ),
)
def _(spark, d):
    v = ct_windows(spark, d)[1]
    return v.select("window", "ticker", "benchmark", "verdict", "best_signal", r8("best_ic").alias("best_ic"))


# ---- large members ------------------------------------------------------------------

part(
    "mg_days",
    "SELECT date, CASE WHEN i < (373 + n - 22) // 2 THEN 'H1' ELSE 'H2' END AS half FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM common) WHERE i >= 373 AND i <= n - 22",
    "common",
)
part(
    "mg_fwd",
    f"SELECT ticker, date, {', '.join(f'(lead(close, {h}) OVER w - lead(close, 1) OVER w) / lead(close, 1) OVER w AS n{h}' for h in H)} FROM aligned {W}",
    "aligned",
)
part(
    "mg_obs",
    f"""
SELECT m.ticker, m.date, half, horizon, {NF} AS fwd, composite, iso_rs_multi, trend_raw / 2.0::DOUBLE AS trend, vc, iso_hist_pct,
  CASE WHEN rank <= 3 THEN 'LEADING' WHEN rank > members - 3 THEN 'WEAKENING' ELSE 'NEUTRAL' END AS label
FROM mcomp m JOIN mg_days USING (date) JOIN mg_fwd f ON f.ticker = m.ticker AND f.date = m.date, {HV} WHERE members >= 6""",
    "mcomp",
    "mg_days",
    "mg_fwd",
)


def megacap(spark, d):
    return bt.megacap_backtest(aligned(spark, d))


@query(
    "composite_backtest_daily",
    "I-14 W-21",
    with_parts(date_ic_sql("(SELECT 'composite' AS segment, horizon, ticker, date, half, composite AS score, fwd FROM mg_obs)", "average", 4), "mg_obs"),
)
def _(spark, d):
    return out_date_ic(megacap(spark, d).date_ic)


@query(
    "composite_backtest_ingredients",
    "I-14",
    with_parts(
        pooled_sql(
            """(SELECT 'rs_multi' AS segment, horizon, ticker, date, iso_rs_multi AS score, fwd FROM mg_obs UNION ALL SELECT 'trend', horizon, ticker, date, trend, fwd FROM mg_obs
 UNION ALL SELECT 'volume', horizon, ticker, date, vc, fwd FROM mg_obs UNION ALL SELECT 'hist_pct', horizon, ticker, date, iso_hist_pct, fwd FROM mg_obs)""",
            "average",
            4,
        ),
        "mg_obs",
    ),
)
def _(spark, d):
    return out_pooled(megacap(spark, d).pooled_ic)


@query(
    "composite_backtest_labels",
    "I-14",
    with_parts(mean_sql("(SELECT label AS bucket, horizon, fwd FROM mg_obs)", "bucket, horizon"), "mg_obs"),
)
def _(spark, d):
    return out_buckets(megacap(spark, d).buckets, "bucket", "horizon")


# ---- insiders -----------------------------------------------------------------------

IS, IE = "1996-01-01", "1999-12-31"
part(
    "ins_active",
    f"""
SELECT ticker, date, count(DISTINCT nm) AS n_buyers FROM (
  SELECT ticker, unnest(generate_series(transaction_date, transaction_date + 29, INTERVAL 1 DAY))::DATE AS date,
    CASE WHEN transaction_code = 'P' AND is_open_market THEN coalesce(insider_name, '') END AS nm
  FROM trades WHERE (transaction_code = 'S' OR (transaction_code = 'P' AND is_open_market)) AND transaction_date >= DATE '{IS}' - 35 AND transaction_date <= DATE '{IE}')
GROUP BY 1, 2""",
    "trades",
)
part(
    "ins_px",
    f"SELECT ticker, date, close, row_number() OVER w AS idx, {ret_sql(20)} AS r FROM bars WHERE date BETWEEN DATE '{IS}' AND DATE '{IE}' + 35 {W}",
    "bars",
)
part(
    "ins_rows",
    f"""
SELECT *, coalesce(CASE WHEN n_buyers >= 3 THEN 2 WHEN n_buyers >= 1 THEN 1 WHEN n_buyers = 0 THEN -1 END, 0)::DOUBLE AS score FROM (
SELECT g.ticker, g.date, a.n_buyers, g.p_ret, (x5.close - x1.close) / x1.close AS n5, (x10.close - x1.close) / x1.close AS n10, (x20.close - x1.close) / x1.close AS n20
FROM (SELECT q.ticker, q.date, q.p_ret, coalesce(f.idx, 0) AS idx FROM (SELECT n.ticker, n.date, p.r AS p_ret FROM (
   SELECT u.ticker, c.date, coalesce(v.parent, 'NATION_0') AS parent FROM (SELECT parent AS ticker FROM edges UNION SELECT child FROM edges UNION SELECT ticker FROM themes) u
     SEMI JOIN trades t ON t.ticker = u.ticker SEMI JOIN bars b ON b.ticker = u.ticker
     LEFT JOIN (SELECT child, parent FROM edges WHERE parent IN ('NATION_0','NATION_1','NATION_2') QUALIFY row_number() OVER (PARTITION BY child ORDER BY position) = 1) v ON v.child = u.ticker
     CROSS JOIN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM cal WHERE date BETWEEN DATE '{IS}' AND DATE '{IE}') WHERE i % 5 = 0) c) n
   ASOF LEFT JOIN ins_px p ON p.ticker = n.parent AND n.date >= p.date) q
  ASOF LEFT JOIN ins_px f ON f.ticker = q.ticker AND q.date >= f.date) g
LEFT JOIN ins_px x1 ON x1.ticker = g.ticker AND x1.idx = g.idx + 1 LEFT JOIN ins_px x5 ON x5.ticker = g.ticker AND x5.idx = g.idx + 5
LEFT JOIN ins_px x10 ON x10.ticker = g.ticker AND x10.idx = g.idx + 10 LEFT JOIN ins_px x20 ON x20.ticker = g.ticker AND x20.idx = g.idx + 20
LEFT JOIN ins_active a ON a.ticker = g.ticker AND a.date = g.date) WHERE coalesce(n5, n10, n20) IS NOT NULL""",
    "ins_active",
    "ins_px",
    "edges",
    "themes",
    "trades",
    "bars",
    "cal",
)
part(
    "ins_seg",
    half_sql(
        "(SELECT *, unnest(['all'] || CASE WHEN p_ret < -0.05::DOUBLE AND p_ret >= -0.15::DOUBLE THEN ['correction'] ELSE [] END || CASE WHEN score = 2 THEN ['cluster'] ELSE [] END) AS segment FROM ins_rows)",
        "segment",
    )[1:-1],
    "ins_rows",
)


def insider(spark, d):
    from crosstide.operators.graph import universe

    e = inp.edges(spark, d)
    return bt.insider_backtest(
        inp.bars(spark, d), inp.trades(spark, d), e, universe(e, inp.themes(spark, d)), inp.VALIDATED, "NATION_0", IS, IE
    )


@query(
    "insider_backtest",
    "I-15 I-17 G-17 J-13",
    with_parts(
        f"""SELECT segment, horizon, n, {r8s('ic')} AS ic, {r8s('ic_h1')} AS ic_h1, {r8s('ic_h2')} AS ic_h2,
 CASE WHEN n < 100 THEN 'INSUF' WHEN ic IS NULL OR ic_h1 IS NULL OR ic_h2 IS NULL THEN 'N/A' WHEN ic > 0.05::DOUBLE AND ic_h1 > 0 AND ic_h2 > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT i.segment, i.horizon, i.n, i.ic AS ic, i.ic_h1 AS ic_h1, i.ic_h2 AS ic_h2 FROM {halves_sql(f'(SELECT segment, ticker, date, half, score, horizon, {NF} AS fwd FROM ins_seg, {HV})', 'segment, horizon', 'ordinal', 5, 'ticker, date')} i)""",
        "ins_seg",
    ),
)
def _(spark, d):
    p = insider(spark, d).pooled_ic
    return p.select("segment", "horizon", "n", r8("ic").alias("ic"), r8("ic_h1").alias("ic_h1"), r8("ic_h2").alias("ic_h2"), "verdict")


@query(
    "insider_signal_distribution",
    "I-15",
    with_parts(
        "SELECT segment, CASE score WHEN 2 THEN 'CLUSTER_BUY' WHEN 1 THEN 'BUY_SIGNAL' WHEN -1 THEN 'SELL_SIGNAL' ELSE 'NEUTRAL' END AS label, count(*) AS n FROM ins_seg GROUP BY 1, 2",
        "ins_seg",
    ),
)
def _(spark, d):
    return insider(spark, d).buckets


# ---- stored strength ----------------------------------------------------------------

part("pic_rows", "SELECT a.ticker, a.parent, a.date, rs_score AS score, (lead5 - lead1) / lead1 AS fwd FROM (SELECT a.* FROM rs_adj a SEMI JOIN bars p ON p.ticker = a.parent AND p.date = a.date WHERE rs_score IS NOT NULL) a JOIN (SELECT ticker, date, lead(close, 1) OVER w AS lead1, lead(close, 5) OVER w AS lead5 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) f USING (ticker, date)", "rs_adj", "bars")
part(
    "pic_half",
    "SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker, parent ORDER BY date) - 1 < count(*) OVER (PARTITION BY ticker, parent) // 2 THEN 'H1' ELSE 'H2' END AS half FROM pic_rows WHERE fwd IS NOT NULL",
    "pic_rows",
)
part(
    "pic",
    f"""
SELECT s.ticker, s.parent, s.n_stored, {', '.join(f'CASE WHEN s.n_stored >= 10 AND n >= 10 THEN {c} END AS {c}' for c in ('ic', 'ic_h1', 'ic_h2'))}
FROM (SELECT ticker, parent, count(*) AS n_stored FROM pic_rows GROUP BY 1, 2) s LEFT JOIN {halves_sql('pic_half', 'ticker, parent', 'ordinal', 5, 'date')} i USING (ticker, parent)""",
    "pic_rows",
    "pic_half",
)


def stored_strength(spark, d):
    allb = inp.series(spark, d, "nation", "market")
    own, market = allb.filter(F.col("ticker") != inp.MARKET), allb.filter(F.col("ticker") == inp.MARKET)
    pairs = inp.edges(spark, d).select(F.col("child").alias("ticker"), "parent")
    none = spark.createDataFrame([], "ticker string, parent string, date date")
    return own, sg.accumulate_rs(own, pairs, market, none)


@query(
    "candidate_pair_ic",
    "I-16",
    with_parts(
        f"SELECT ticker, parent, n_stored, {r8s('ic')} AS ic_full, {r8s('ic_h1')} AS ic_h1, {r8s('ic_h2')} AS ic_h2, coalesce(pic.ic_h1 > 0.05::DOUBLE AND pic.ic_h2 > 0.05::DOUBLE, FALSE) AS passed FROM pic",
        "pic",
    ),
)
def _(spark, d):
    own, rs = stored_strength(spark, d)
    p = bt.pair_ic(rs, own)
    return p.select("ticker", "parent", "n_stored", r8("ic_full").alias("ic_full"), r8("ic_h1").alias("ic_h1"), r8("ic_h2").alias("ic_h2"), "passed")
