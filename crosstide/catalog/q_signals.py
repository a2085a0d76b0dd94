"""Queries over signals: strength, baskets, rotation, divergence, ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crosstide.catalog import inputs as inp
from crosstide.catalog import q_features  # noqa: F401  (defines shared SQL parts)
from crosstide.catalog.registry import query, r8
from crosstide.catalog.sqlparts import W, part, r8s, ret_sql, with_parts
from crosstide.operators import features as ft
from crosstide.operators import graph as gr
from crosstide.operators import ranking as rk
from crosstide.plans import signals as sg
from crosstide.session import checkpoint_dir, reliable_checkpoint
from crosstide.streaming.accumulate import accumulate_batch

# ---- graph --------------------------------------------------------------------------


@query(
    "graph_edges",
    "S-05 G-26",
    with_parts("SELECT parent, child, weight FROM edges", "edges"),
)
def _(spark, d):
    return gr.unique_edges(inp.edges(spark, d)).select("parent", "child", "weight")


@query(
    "graph_dependents",
    "G-26",
    with_parts("SELECT child, weight FROM edges WHERE parent = 'NATION_1'", "edges"),
)
def _(spark, d):
    return gr.dependents(inp.edges(spark, d), "NATION_1").select("child", "weight")


@query(
    "graph_parents",
    "G-26",
    with_parts("SELECT parent, weight FROM edges WHERE child = 'NATION_7'", "edges"),
)
def _(spark, d):
    return gr.parents(inp.edges(spark, d), "NATION_7").select("parent", "weight")


@query(
    "graph_edge_weight",
    "G-26",
    with_parts("SELECT parent, child, weight FROM edges WHERE parent = 'NATION_2' AND child = 'NATION_7' ORDER BY position LIMIT 1", "edges"),
)
def _(spark, d):
    return gr.edge_weight(inp.edges(spark, d), "NATION_2", "NATION_7")


@query(
    "graph_loaded_edges",
    "S-05",
    with_parts("SELECT parent, child, weight FROM edges", "edges"),
)
def _(spark, d):
    # an edge list is configuration: a few rows per ticker pair, read from a file by its owner
    rows = [r.asDict() | {"type": r["edge_type"]} for r in inp.edges(spark, d).collect()]
    return gr.load_edges(spark, rows).select("parent", "child", "weight")


@query(
    "graph_best_parent",
    "G-26",
    with_parts(
        "SELECT child, parent, weight FROM edges QUALIFY row_number() OVER (PARTITION BY child ORDER BY weight DESC, position) = 1",
        "edges",
    ),
)
def _(spark, d):
    return gr.best_parent(inp.edges(spark, d)).select("child", "parent", "weight")


@query(
    "universe",
    "S-07 T-08",
    with_parts(
        "SELECT parent AS ticker FROM edges UNION SELECT child FROM edges UNION SELECT ticker FROM themes UNION SELECT benchmark FROM themes UNION SELECT ticker FROM bars",
        "edges",
        "themes",
        "bars",
    ),
)
def _(spark, d):
    th = inp.themes(spark, d)
    return gr.universe(inp.edges(spark, d), th, th.select(F.col("benchmark").alias("ticker")), inp.bars(spark, d))


# ---- relative strength --------------------------------------------------------------

part("r20", f"SELECT ticker, date, {ret_sql(20)} AS r FROM bars {W}", "bars")
part(
    "rs",
    """
SELECT ticker, parent, date, score, parent_ret FROM (
  SELECT c.ticker, c.parent, c.date, (c.r - p.r) * c.weight AS score, p.r AS parent_ret
  FROM (SELECT ticker, date, r, parent, weight FROM r20 JOIN edges ON child = ticker) c
  ASOF JOIN r20 p ON p.ticker = c.parent AND c.date >= p.date)
WHERE score IS NOT NULL""",
    "r20",
    "edges",
)


@query(
    "relative_strength",
    "G-01 J-01 J-03",
    with_parts(f"SELECT ticker, parent, date, {r8s('score')} AS score FROM rs", "rs"),
)
def _(spark, d):
    return sg.rs(inp.bars(spark, d), inp.edges(spark, d)).select("ticker", "parent", "date", r8("score").alias("score"))


@query(
    "relative_strength_normalised",
    "G-02",
    with_parts(
        f"""vol AS (SELECT ticker, date, CASE WHEN rn > 20 THEN stddev_samp(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END AS v
  FROM (SELECT ticker, date, row_number() OVER w AS rn, {ret_sql(1)} AS r FROM bars {W}))
SELECT ticker, parent, date, {r8s('score / nullif(v, 0)')} AS score FROM rs JOIN vol USING (ticker, date) WHERE v > 0""".replace("vol AS", "WITH vol AS", 1),
        "rs",
    ),
)
def _(spark, d):
    return sg.rs_normalized(inp.bars(spark, d), inp.edges(spark, d)).select(
        "ticker", "parent", "date", r8("score").alias("score")
    )


@query(
    "scored_edges",
    "G-01 W-16 G-22 J-16",
    with_parts(
        f"""SELECT ticker, parent, date, {r8s('score')} AS score, {r8s('pct')} AS pct_below, rank_desc, n_valid,
  CASE WHEN pct >= 0.8::DOUBLE THEN 'STRONG_BUY' WHEN pct >= 0.6::DOUBLE THEN 'BUY' WHEN pct >= 0.2::DOUBLE THEN 'HOLD' ELSE 'SELL' END AS action
FROM (SELECT *, (rank() OVER (PARTITION BY date ORDER BY score) - 1) / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) AS pct,
  rank() OVER (PARTITION BY date ORDER BY score DESC) AS rank_desc, count(*) OVER (PARTITION BY date) AS n_valid FROM rs)""",
        "rs",
    ),
)
def _(spark, d):
    s = rk.with_cross_section(sg.rs(inp.bars(spark, d), inp.edges(spark, d)), ["date"], "score")
    return s.select(
        "ticker",
        "parent",
        "date",
        r8("score").alias("score"),
        r8("pct_below").alias("pct_below"),
        "rank_desc",
        "n_valid",
        rk.action_label(F.col("pct_below")).alias("action"),
    )


@query(
    "pooled_percentile",
    "W-16",
    with_parts(
        f"""SELECT ticker, parent, date, {r8s('(rank() OVER (ORDER BY score) - 1) / CAST(count(*) OVER () AS DOUBLE)')} AS pct_below,
  rank() OVER (ORDER BY score DESC) AS rank_desc FROM rs""",
        "rs",
    ),
)
def _(spark, d):
    s = rk.with_cross_section(sg.rs(inp.bars(spark, d), inp.edges(spark, d)), [], "score", pooled=True)
    return s.select("ticker", "parent", "date", r8("pct_below").alias("pct_below"), "rank_desc")


@query(
    "regime_gate",
    "G-22 X-13",
    with_parts(
        """WITH regimes(parent, regime) AS (VALUES ('NATION_0','CORRECTION'),('NATION_1','CORRECTION'),('NATION_1','MILD_PULLBACK'),('NATION_2','UP'),('NATION_2','CORRECTION')),
labelled AS (SELECT ticker, parent, date,
  CASE WHEN parent_ret > 0 THEN 'UP' WHEN parent_ret >= -0.05::DOUBLE THEN 'MILD_PULLBACK' WHEN parent_ret >= -0.15::DOUBLE THEN 'CORRECTION' ELSE 'DRAWDOWN' END AS regime,
  CASE WHEN pct >= 0.8::DOUBLE THEN 'STRONG_BUY' WHEN pct >= 0.6::DOUBLE THEN 'BUY' WHEN pct >= 0.2::DOUBLE THEN 'HOLD' ELSE 'SELL' END AS action
  FROM (SELECT *, (rank() OVER (PARTITION BY date ORDER BY score) - 1) / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) AS pct FROM rs))
SELECT ticker, l.parent, date, l.regime,
  CASE WHEN l.parent NOT IN ('NATION_0','NATION_1','NATION_2') THEN 'WAIT - unvalidated' WHEN r.parent IS NOT NULL THEN action ELSE 'WAIT' END AS action_label
FROM labelled l LEFT JOIN regimes r ON r.parent = l.parent AND r.regime = l.regime""",
        "rs",
    ),
)
def _(spark, d):
    from crosstide.plans.scan import regime_gate, regime_table

    s = rk.with_cross_section(sg.rs(inp.bars(spark, d), inp.edges(spark, d)), ["date"], "score")
    s = s.withColumn("regime", rk.regime(F.col("parent_ret"))).withColumn("action", rk.action_label(F.col("pct_below")))
    gated = regime_gate(s, regime_table(spark, inp.REGIMES), inp.VALIDATED)
    return gated.select("ticker", "parent", "date", "regime", "action_label")


part(
    "rs_prev",
    f"SELECT ticker, date, {ret_sql(20)} AS r, (lag(close, 1) OVER w - lag(close, 21) OVER w) / nullif(lag(close, 21) OVER w, 0) AS rp FROM bars {W}",
    "bars",
)


@query(
    "relative_strength_trend",
    "W-05",
    with_parts(
        """SELECT ticker, parent, date, CASE WHEN today IS NULL OR prev IS NULL THEN '—' WHEN today > prev + 0.01::DOUBLE THEN '↑'
  WHEN today < prev - 0.01::DOUBLE THEN '↓' ELSE '→' END AS rs_trend
FROM (SELECT c.ticker, c.parent, c.date, c.r - p.r AS today, c.rp - p.rp AS prev
  FROM (SELECT ticker, date, r, rp, parent FROM rs_prev JOIN edges ON child = ticker) c
  ASOF LEFT JOIN rs_prev p ON p.ticker = c.parent AND c.date >= p.date)""",
        "rs_prev",
        "edges",
    ),
)
def _(spark, d):
    return sg.rs_trend(inp.bars(spark, d), inp.edges(spark, d))


part("r20i", f"SELECT ticker, date, {ret_sql(20)} AS r, row_number() OVER w AS ti FROM bars {W}", "bars")
part("mr20", f"SELECT date, {ret_sql(20)} AS m FROM market_bars {W}", "market_bars")
part(
    "adj_pairs",
    """
SELECT c.ticker, c.parent, c.date, c.ti, c.r, p.r AS pr, p.ti AS pti, c.mi, c.m
FROM (SELECT x.*, y.m, y.mi FROM (SELECT ticker, date, r, ti, parent FROM r20i JOIN edges ON child = ticker) x
  ASOF LEFT JOIN (SELECT mr20.date, m, row_number() OVER (ORDER BY mr20.date) AS mi FROM mr20) y ON x.date >= y.date) c
ASOF LEFT JOIN r20i p ON p.ticker = c.parent AND c.date >= p.date""",
    "mr20",
    "edges",
    "r20i",
)
part(
    "pair_betas",
    """
SELECT k.ticker, k.ti, k.mi, covar_samp(t.r, m.m) / nullif(var_samp(m.m), 0) AS beta
FROM (SELECT ticker, ti, mi FROM adj_pairs UNION SELECT parent, pti, mi FROM adj_pairs) k
JOIN tret t ON t.ticker = k.ticker AND t.ti BETWEEN k.ti - 59 AND k.ti JOIN mret m ON m.mi = k.mi - (k.ti - t.ti)
WHERE k.ti > 60 AND k.mi > 60 GROUP BY 1, 2, 3 HAVING count(t.r) = 60 AND count(m.m) = 60""",
    "adj_pairs",
    "tret",
    "mret",
)
part(
    "rs_adj",
    """
SELECT a.ticker, a.parent, a.date, r - pr AS rs_score, (r - cb.beta * m) - (pr - pb.beta * m) AS rs_adj
FROM adj_pairs a LEFT JOIN pair_betas cb ON cb.ticker = a.ticker AND cb.ti = a.ti AND cb.mi = a.mi
LEFT JOIN pair_betas pb ON pb.ticker = a.parent AND pb.ti = a.pti AND pb.mi = a.mi""",
    "adj_pairs",
    "pair_betas",
)


def _split(spark, d):
    allb = inp.series(spark, d, "nation", "market")
    return allb.filter(F.col("ticker") != inp.MARKET), allb.filter(F.col("ticker") == inp.MARKET)


@query(
    "beta_adjusted_strength",
    "G-03",
    with_parts(
        f"SELECT ticker, parent, date, {r8s('rs_score')} AS rs_score, {r8s('rs_adj', 7)} AS rs_adj FROM rs_adj WHERE rs_adj IS NOT NULL",
        "rs_adj",
    ),
)
def _(spark, d):
    own, market = _split(spark, d)
    pairs = inp.edges(spark, d).select(F.col("child").alias("ticker"), "parent")
    out = sg.rs_beta_adjusted(own, pairs, market).filter(F.col("rs_adj").isNotNull())
    return out.select("ticker", "parent", "date", r8("rs_score").alias("rs_score"), r8("rs_adj", 7).alias("rs_adj"))


@query(
    "accumulated_strength",
    "G-04",
    with_parts(
        f"""SELECT a.ticker, a.parent, a.date, {r8s('rs_score')} AS rs_score, {r8s('rs_adj', 7)} AS rs_adj FROM rs_adj a
SEMI JOIN bars p ON p.ticker = a.parent AND p.date = a.date
WHERE rs_score IS NOT NULL AND a.date >= DATE '1997-01-01'""",
        "rs_adj",
        "bars",
    ),
)
def _(spark, d):
    own, market = _split(spark, d)
    pairs = inp.edges(spark, d).select(F.col("child").alias("ticker"), "parent")
    # everything before 1997 counts as stored already
    stored = own.join(pairs, "ticker").filter(F.col("date") < F.lit("1997-01-01").cast("date"))
    out = sg.accumulate_rs(own, pairs, market, stored)
    return out.select("ticker", "parent", "date", r8("rs_score").alias("rs_score"), r8("rs_adj", 7).alias("rs_adj"))


@query(
    "accumulated_in_batches",
    "G-04",
    with_parts(
        f"""SELECT a.ticker, a.parent, a.date, {r8s('rs_score')} AS rs_score, {r8s('rs_adj', 7)} AS rs_adj FROM rs_adj a
SEMI JOIN bars p ON p.ticker = a.parent AND p.date = a.date WHERE rs_score IS NOT NULL""",
        "rs_adj",
        "bars",
    ),
)
def _(spark, d):
    """All bars in three batches: up to 1996, up to mid-1997 with one month's bars missing, and the rest with that month."""
    own, market = _split(spark, d)
    pairs = inp.edges(spark, d).select(F.col("child").alias("ticker"), "parent")
    bars = reliable_checkpoint(own.select("ticker", "date", "adj_close").unionByName(market.select(F.lit(inp.MARKET).alias("ticker"), "date", "adj_close")))
    month = F.date_format("date", "yyyyMM").cast("int")
    number = F.when((month == 199610) | (month > 199706), 2).when(month > 199512, 1).otherwise(0)
    root = f"{checkpoint_dir(spark)}/strength-{uuid.uuid4().hex}"
    for k in range(3):
        accumulate_batch(bars.filter(number == k), k, pairs, inp.MARKET, f"{root}/bars", f"{root}/rs")
    return spark.read.parquet(f"{root}/rs").select("ticker", "parent", "date", r8("rs_score").alias("rs_score"), r8("rs_adj", 7).alias("rs_adj"))


part("nr20", f"SELECT ticker, date, {ret_sql(20)} AS r FROM nr_bars {W}", "nr_bars")


@query(
    "strength_vs_benchmark",
    "G-05",
    with_parts(
        f"""SELECT c.ticker, c.benchmark, c.date, {r8s('c.r - b.r')} AS rs_score
FROM (SELECT r.ticker, date, r, benchmark FROM nr20 r JOIN themes t ON t.ticker = r.ticker) c
ASOF LEFT JOIN nr20 b ON b.ticker = c.benchmark AND c.date >= b.date""",
        "nr20",
        "themes",
    ),
)
def _(spark, d):
    s = sg.rs_vs_benchmark(inp.series(spark, d, "nation", "region"), inp.themes(spark, d))
    return s.select("ticker", "benchmark", "date", r8("rs_score").alias("rs_score"))


@query(
    "theme_activity",
    "G-06",
    with_parts(
        f"""WITH rr AS (SELECT ticker, date, {ret_sql(20)} AS r FROM region_bars {W})
SELECT benchmark, date, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s > 0 THEN 'ACTIVE' WHEN s >= -0.02::DOUBLE THEN 'NEUTRAL' ELSE 'INACTIVE' END AS theme_active
FROM (SELECT rr.ticker AS benchmark, rr.date, rr.r - mr20.m AS s FROM rr ASOF LEFT JOIN mr20 ON rr.date >= mr20.date)""",
        "region_bars",
        "mr20",
    ),
)
def _(spark, d):
    return sg.theme_activity(inp.series(spark, d, "region", "market"), inp.themes(spark, d), inp.MARKET)


# ---- baskets ------------------------------------------------------------------------

part(
    "zs",
    """
SELECT theme, ticker, date, r, CASE WHEN count(r) OVER g >= 3 THEN (r - avg(r) OVER g) / nullif(stddev_pop(r) OVER g, 0) END AS z
FROM r20 JOIN themes USING (ticker) WINDOW g AS (PARTITION BY theme, date)""",
    "r20",
    "themes",
)


@query(
    "basket_zscore",
    "G-07 W-17 A-05",
    with_parts(f"SELECT theme, ticker, date, {r8s('z', 6)} AS z FROM zs", "zs"),
)
def _(spark, d):
    z = sg.basket_zscore(inp.bars(spark, d), inp.themes(spark, d))
    return z.select("theme", "ticker", "date", r8("z", 6).alias("z"))


SCAN_DATE = "1998-06-30"
part("cal", "SELECT DISTINCT date FROM bars", "bars")
part(
    "zgrid",
    f"""
SELECT g.theme, g.date, g.ticker, f.close AS price, f.date AS latest_date, f.r, f.rvol
FROM (SELECT theme, ticker, date FROM themes CROSS JOIN cal) g
ASOF LEFT JOIN (SELECT ticker, date, close, {ret_sql(20)} AS r,
   CASE WHEN row_number() OVER w > 20 THEN volume / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS rvol
   FROM bars {W}) f ON f.ticker = g.ticker AND g.date >= f.date""",
    "themes",
    "cal",
    "bars",
)


@query(
    "zscore_volume_scan",
    "G-08 T-05",
    with_parts(
        f"""SELECT theme, date, ticker, {r8s('price')} AS price, latest_date, {r8s('r')} AS ret_20d, {r8s('z', 6)} AS z, {r8s('z * rvol', 6)} AS combined,
  CASE WHEN z * rvol IS NULL THEN '—' WHEN z * rvol > 1.5::DOUBLE THEN 'STRONG_BUY' WHEN z * rvol > 0.5::DOUBLE THEN 'BUY' WHEN z * rvol > -0.5::DOUBLE THEN 'HOLD' ELSE 'SELL' END AS action
FROM (SELECT *, CASE WHEN count(r) OVER g >= 3 THEN (r - avg(r) OVER g) / nullif(stddev_pop(r) OVER g, 0) END AS z FROM zgrid WINDOW g AS (PARTITION BY theme, date))""",
        "zgrid",
    ),
)
def _(spark, d):
    b = inp.bars(spark, d)
    s = sg.zscore_rvol_scan(b, inp.themes(spark, d), sg.trading_dates(b))
    return s.select(
        "theme",
        "date",
        "ticker",
        r8("price").alias("price"),
        "latest_date",
        r8("ret_20d").alias("ret_20d"),
        r8("z", 6).alias("z"),
        r8("combined", 6).alias("combined"),
        "action",
    ).orderBy("theme", "date", sg.label_order(F.col("action")), F.desc_nulls_last("combined"))


@query(
    "cross_section_minmax",
    "W-18 A-04",
    with_parts(
        f"""SELECT ticker, date, {r8s('CASE WHEN r IS NULL THEN NULL WHEN lo = hi THEN 0.5::DOUBLE ELSE (r - lo) / (hi - lo) END')} AS norm_r
FROM (SELECT *, min(r) OVER (PARTITION BY date) AS lo, max(r) OVER (PARTITION BY date) AS hi FROM r20)""",
        "r20",
    ),
)
def _(spark, d):
    x = inp.bars(spark, d).select("ticker", "date", ft.ret(20).alias("r"))
    return rk.xs_minmax(x, ["date"], ["r"]).select("ticker", "date", r8("norm_r").alias("norm_r"))


@query(
    "null_skipping_means",
    "A-08 G-20",
    with_parts(
        f"""SELECT ticker, date, {r8s('(coalesce(a,0) + coalesce(b,0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0)')} AS mean_ret,
  {r8s('(coalesce(a*0.7::DOUBLE,0) + coalesce(b*0.3::DOUBLE,0)) / nullif((a IS NOT NULL)::INT * 0.7::DOUBLE + (b IS NOT NULL)::INT * 0.3::DOUBLE, 0)')} AS composite
FROM (SELECT ticker, date, {ret_sql(20)} AS a, {ret_sql(60)} AS b FROM bars {W})""",
        "bars",
    ),
)
def _(spark, d):
    x = inp.bars(spark, d).select("ticker", "date", ft.ret(20).alias("a"), ft.ret(60).alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select(
        "ticker",
        "date",
        r8(rk.mean_non_null(a, b)).alias("mean_ret"),
        r8(rk.weighted_mean_non_null([(a, 0.7), (b, 0.3)])).alias("composite"),
    )


# ---- composite of large members -----------------------------------------------------

MEMBER_COUNT = 10
part(
    "common",
    "SELECT date FROM member_bars GROUP BY 1 HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM member_bars)",
    "member_bars",
)
part(
    "benchcal",
    """
SELECT date, last_value(m IGNORE NULLS) OVER o AS b0, last_value(a IGNORE NULLS) OVER o AS b1
FROM (SELECT c.date, m.close AS m, a.close AS a FROM common c LEFT JOIN market_bars m ON m.date = c.date
  LEFT JOIN region_bars a ON a.date = c.date AND a.ticker = 'AFRICA')
WINDOW o AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "common",
    "market_bars",
    "region_bars",
)
part(
    "aligned",
    "SELECT m.ticker, date, m.close, m.volume, b0, b1 FROM member_bars m JOIN common USING (date) JOIN benchcal USING (date)",
    "member_bars",
    "common",
    "benchcal",
)


def aligned(spark, d):
    # one row per series and day, read by every step of the alignment: the lines are read once
    allb = reliable_checkpoint(inp.series(spark, d, "member", "region", "market"))
    members = allb.filter(F.col("ticker").contains("-")).select("ticker").distinct()
    return sg.align_ffill(allb, members, [inp.MARKET, inp.FOCUS_SECTOR])


@query(
    "aligned_members",
    "W-21",
    with_parts("SELECT ticker, date, close, volume, b0 AS bench_0, b1 AS bench_1 FROM aligned", "aligned"),
)
def _(spark, d):
    # prices are ratios of integer sums: compared bit for bit, without rounding
    return aligned(spark, d).select("ticker", "date", "close", "volume", "bench_0", "bench_1")


def _hist(n: int) -> str:
    return (
        f"CASE WHEN rn >= {252 + n + 1} THEN len(list_filter(list(r{n}) OVER (PARTITION BY ticker ORDER BY date "
        f"ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), lambda x: x < r{n})) / 252.0::DOUBLE END AS h{n}"
    )


def _mm(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER d = min({c}) OVER d THEN 0.5::DOUBLE "
        f"ELSE ({c} - min({c}) OVER d) / (max({c}) OVER d - min({c}) OVER d) END AS n_{c}"
    )


def _avg(*cs: str) -> str:
    return (
        "(" + " + ".join(f"coalesce({c}, 0)" for c in cs) + ") / nullif("
        + " + ".join(f"({c} IS NOT NULL)::INT" for c in cs) + ", 0)"
    )


def composite_parts(suffix: str, warmup: int, min_valid: int) -> None:
    tfs = (20, 60, 120)
    diffs = [f"d{b}_{n}" for n in tfs for b in (0, 1)]
    up = "CASE WHEN close > lag(close) OVER w THEN volume ELSE 0 END AS up"
    f20 = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    part(
        f"mfeat{suffix}",
        f"""
SELECT * FROM (SELECT *, {', '.join(_hist(n) for n in tfs)},
  CASE WHEN rn > 20 THEN sum(up) {f20} / sum(volume) {f20} END AS vc, count(*) OVER (PARTITION BY date) AS _all
FROM (SELECT ticker, date, close, volume, row_number() OVER w AS rn, {up},
  {', '.join(f'{ret_sql(n)} AS r{n}' for n in tfs)},
  {', '.join(f'({ret_sql(n)}) - ({ret_sql(n, f"b{b}")}) AS d{b}_{n}' for n in tfs for b in (0, 1))},
  CASE WHEN row_number() OVER w >= 200 THEN CAST(close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS INTEGER)
   + CAST(close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS INTEGER) END AS trend_raw
  FROM aligned {W}))
WHERE rn > {warmup}""",
        "aligned",
    )
    part(
        f"mcomp{suffix}",
        f"""
SELECT *, row_number() OVER (PARTITION BY date ORDER BY composite DESC NULLS LAST, ticker) AS rank, count(*) OVER (PARTITION BY date) AS members FROM (
SELECT *, {_avg('composite_rs', 'trend_raw / 2.0::DOUBLE', 'vc')} AS composite FROM (
SELECT *, {_avg('c20', 'c60', 'c120')} AS composite_rs FROM (
SELECT *, {', '.join(f"{_avg(f'n_d0_{n}', f'n_d1_{n}', f'h{n}')} AS c{n}" for n in tfs)},
  {_avg(*diffs)} AS iso_rs_multi, {_avg('h20', 'h60', 'h120')} AS iso_hist_pct FROM (
SELECT *, {', '.join(_mm(c) for c in diffs)} FROM mfeat{suffix} WINDOW d AS (PARTITION BY date)))))
WHERE true QUALIFY members >= {min_valid}""",
        f"mfeat{suffix}",
    )


composite_parts("", 0, 1)


@query(
    "member_composite",
    "G-11 T-03",
    with_parts(
        f"""SELECT ticker, date, {r8s('composite', 7)} AS composite, {r8s('composite_rs', 7)} AS composite_rs, trend_raw, rank,
  CASE WHEN rank <= 3 THEN 'LEADING' WHEN rank >= 8 THEN 'WEAKENING' ELSE 'NEUTRAL' END AS label FROM mcomp""",
        "mcomp",
    ),
)
def _(spark, d):
    c = sg.megacap_composite(aligned(spark, d))
    return c.select(
        "ticker", "date", r8("composite", 7).alias("composite"), r8("composite_rs", 7).alias("composite_rs"), "trend_raw", "rank", "label"
    )


# ---- rotation -----------------------------------------------------------------------

part(
    "rot_feat",
    f"SELECT ticker, date, {ret_sql(20)} AS r20, {ret_sql(60)} AS r60, row_number() OVER w AS seen FROM (SELECT * FROM region_bars WHERE ticker IN ('AFRICA','AMERICA','ASIA','EUROPE') UNION ALL SELECT * FROM market_bars) {W}",
    "region_bars",
    "market_bars",
)
part(
    "rotation",
    f"""
SELECT date, max(CASE WHEN pos = 0 THEN rank END) AS focus_rank, max(CASE WHEN pos = 0 THEN r20 END) AS focus_20d,
  max(CASE WHEN pos = 0 THEN r60 END) AS focus_60d, max(CASE WHEN pos = 4 THEN r20 END) AS market_20d,
  count(CASE WHEN pos < 4 AND seen >= 65 THEN 1 END) = 4 AS data_available
FROM (SELECT *, CASE WHEN comp IS NULL THEN 4 ELSE row_number() OVER (PARTITION BY date, pos < 4 ORDER BY comp DESC NULLS LAST, pos) END AS rank
  FROM (SELECT g.date, g.pos, f.r20, f.r60, f.seen, {_avg('f.r20', 'f.r60')} AS comp
    FROM (SELECT date, pos, ticker FROM (VALUES ('AFRICA',0),('AMERICA',1),('ASIA',2),('EUROPE',3),('MARKET',4)) s(ticker, pos) CROSS JOIN cal) g
    ASOF LEFT JOIN rot_feat f ON f.ticker = g.ticker AND g.date >= f.date))
GROUP BY date""",
    "rot_feat",
    "cal",
)


@query(
    "sector_rotation",
    "G-12 P-02",
    with_parts(
        f"""SELECT date, focus_rank, CASE WHEN focus_rank <= 2 THEN 'LEADING' WHEN focus_rank = 3 THEN 'NEUTRAL' ELSE 'LAGGING' END AS focus_status,
  {r8s('focus_20d')} AS focus_20d, {r8s('focus_60d')} AS focus_60d, {r8s('focus_20d - market_20d')} AS focus_vs_market, data_available FROM rotation""",
        "rotation",
    ),
)
def _(spark, d):
    b = inp.series(spark, d, "region", "market")
    dates = sg.trading_dates(inp.bars(spark, d))
    rot = sg.sector_rotation(b, inp.SECTORS, inp.FOCUS_SECTOR, inp.MARKET, dates)
    return rot.select(
        "date",
        "focus_rank",
        "focus_status",
        r8("focus_20d").alias("focus_20d"),
        r8("focus_60d").alias("focus_60d"),
        r8("focus_vs_market").alias("focus_vs_market"),
        "data_available",
    )


@query(
    "volatility_level",
    "G-32",
    with_parts(
        """SELECT ticker, date, CASE WHEN v IS NULL THEN '' WHEN v < 15 THEN 'LOW' WHEN v < 20 THEN 'CALM' WHEN v < 30 THEN 'ELEVATED' ELSE 'FEAR' END AS label
FROM (SELECT ticker, date, CASE WHEN row_number() OVER w > 20 THEN sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / 20.0::DOUBLE END AS v
FROM bars """
        + W
        + ")",
        "bars",
    ),
)
def _(spark, d):
    level = F.when(ft.rows_seen() > 20, F.sum("volume").over(ft.frame(-19, 0)) / F.lit(20.0))
    return inp.bars(spark, d).select("ticker", "date", sg.vol_level_label(level).alias("label"))


# ---- divergence ---------------------------------------------------------------------

part("r1", f"SELECT ticker, date, {ret_sql(1)} AS r FROM all_bars {W}", "all_bars")
part(
    "flags_all",
    """
SELECT date, ticker, round(t * 100, 2) AS ticker_1d, round(m * 100, 2) AS market_1d, benchmark, round(b * 100, 2) AS benchmark_1d,
  round((t - m) * 100, 2) AS divergence_vs_market, round((t - b) * 100, 2) AS divergence_vs_benchmark, strength, theme, parent, source
FROM (SELECT *, CASE
   WHEN source = 'theme' AND t >= 0.05::DOUBLE AND b <> 0 AND t >= b * 3 THEN 'SECTOR_OUTPERFORM'
   WHEN m > 0.01::DOUBLE AND t - m >= 0.03::DOUBLE AND t - b >= 0.02::DOUBLE THEN 'STRONG'
   WHEN m <= 0.01::DOUBLE AND t >= 0.02::DOUBLE AND m <= 0 AND t - b >= 0.02::DOUBLE THEN 'STRONG'
   WHEN t >= 0.03::DOUBLE AND b <= -0.01::DOUBLE THEN 'BENCHMARK' END AS strength
  FROM (SELECT x.*, b.r AS b FROM (SELECT g.*, a.r AS t FROM (
      SELECT s.*, cal.date, mm.m FROM (
        SELECT u.ticker, coalesce(bp.parent, u.benchmark) AS benchmark, bp.parent, u.theme_label AS theme,
          CASE WHEN bp.parent IS NULL THEN 'theme' ELSE 'dependency' END AS source
        FROM themes u LEFT JOIN (SELECT child, parent FROM edges QUALIFY row_number() OVER (PARTITION BY child ORDER BY weight DESC, position) = 1) bp ON bp.child = u.ticker) s
      CROSS JOIN cal ASOF JOIN (SELECT date, r AS m FROM r1 WHERE ticker = 'MARKET') mm ON cal.date >= mm.date) g
    ASOF LEFT JOIN r1 a ON a.ticker = g.ticker AND g.date >= a.date) x
   ASOF LEFT JOIN r1 b ON b.ticker = x.benchmark AND x.date >= b.date))
WHERE strength IS NOT NULL""",
    "r1",
    "cal",
    "themes",
    "edges",
)
part(
    "flags",
    """
SELECT *, row_number() OVER (PARTITION BY date ORDER BY divergence_vs_benchmark DESC, source, ticker) AS pos
FROM flags_all QUALIFY pos <= 7""",
    "flags_all",
)


def flags(spark, d, source="all"):
    b = inp.series(spark, d, "nation", "region", "market")
    dates = b.filter(F.col("ticker").startswith("NATION")).select("date").distinct()
    return sg.divergences(b, inp.edges(spark, d), inp.themes(spark, d), inp.MARKET, dates, source)


@query(
    "divergence_flags",
    "G-13 T-04",
    with_parts("SELECT * FROM flags", "flags"),
)
def _(spark, d):
    return flags(spark, d)


# ---- ordering -----------------------------------------------------------------------


@query(
    "top_and_bottom_children",
    "T-01",
    with_parts(
        f"""SELECT ticker, parent, date, {r8s('score')} AS score, pos, CASE WHEN pos <= 3 THEN 'top' ELSE 'bottom' END AS side
FROM (SELECT *, row_number() OVER (PARTITION BY parent, date ORDER BY score DESC, ticker) AS pos, count(*) OVER (PARTITION BY parent, date) AS n FROM rs)
WHERE pos <= 3 OR pos > n - 3""",
        "rs",
    ),
)
def _(spark, d):
    s = rk.top_bottom(sg.rs(inp.bars(spark, d), inp.edges(spark, d)), ["parent", "date"], "score")
    return s.select("ticker", "parent", "date", r8("score").alias("score"), "pos", "side")


@query(
    "top_quintile_children",
    "T-02",
    with_parts(
        f"""SELECT ticker, parent, date, {r8s('score')} AS score, pos
FROM (SELECT *, row_number() OVER (PARTITION BY parent, date ORDER BY score DESC, ticker) AS pos, count(*) OVER (PARTITION BY parent, date) AS n FROM rs)
WHERE pos <= greatest(1, n // 5)""",
        "rs",
    ),
)
def _(spark, d):
    s = rk.top_quintile(sg.rs(inp.bars(spark, d), inp.edges(spark, d)), ["parent", "date"], "score")
    return s.select("ticker", "parent", "date", r8("score").alias("score"), "pos")


@query(
    "largest_market_moves",
    "T-07",
    with_parts(f"SELECT date, {r8s('r')} AS move FROM r1 WHERE ticker = 'MARKET' AND r IS NOT NULL ORDER BY abs(r) DESC, date LIMIT 10", "r1"),
)
def _(spark, d):
    from crosstide.plans.research import largest_moves

    return largest_moves(inp.series(spark, d, "market"), inp.MARKET, 10).select("date", r8("move").alias("move"))


@query(
    "latest_bars_per_ticker",
    "W-14 T-06",
    with_parts(
        f"SELECT ticker, date, {r8s('close')} AS close, rn FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 5",
        "bars",
    ),
)
def _(spark, d):
    return rk.top_n(inp.bars(spark, d), ["ticker"], [F.desc("date")], 5).select("ticker", "date", r8("close").alias("close"), "rn")


# ---- one series per supplier: the widest cross-section ------------------------------


@query(
    "supplier_strength",
    "W-01 W-16 G-01",
    with_parts(
        f"""SELECT ticker, date, {r8s('r')} AS ret_20, {r8s('(rank() OVER (PARTITION BY date ORDER BY r) - 1) / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE)')} AS pct_below
FROM (SELECT ticker, date, {ret_sql(20)} AS r FROM supplier_bars {W}) WHERE r IS NOT NULL""",
        "supplier_bars",
    ),
)
def _(spark, d):
    b = inp.series(spark, d, "supplier").select("ticker", "date", ft.ret(20).alias("ret_20")).filter(F.col("ret_20").isNotNull())
    # a date holds every supplier, a number that grows with the data: rank across partitions
    s = rk.with_cross_section(b, ["date"], "ret_20", pooled=True)
    return s.select("ticker", "date", r8("ret_20").alias("ret_20"), r8("pct_below").alias("pct_below"))
