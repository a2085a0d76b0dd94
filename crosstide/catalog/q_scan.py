"""Queries over scans, insiders, feeds and the journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog import inputs as inp
from crosstide.catalog import q_backtests  # noqa: F401  (defines shared SQL parts)
from crosstide.catalog import q_loads as ql
from crosstide.catalog.q_signals import aligned, flags
from crosstide.catalog.registry import query, r8
from crosstide.catalog.sqlparts import W, part, r8s, ret_sql, with_parts
from crosstide.plans import insiders as ins
from crosstide.plans import journal as jr
from crosstide.plans import scan as sc
from crosstide.plans import signals as sg
from crosstide.sources import tables as tb

D = "1998-06-30"

# ---- insiders -----------------------------------------------------------------------


def summary_part(name: str, trades: str, end: str) -> None:
    buy = "transaction_code = 'P' AND coalesce(is_open_market, FALSE)"
    part(
        name,
        f"""
SELECT ticker, count(*) FILTER ({buy}) AS buy_count, count(DISTINCT insider_name) FILTER ({buy}) AS distinct_insiders,
  coalesce(sum(total_value) FILTER ({buy}), 0) AS total_dollar_value, coalesce(bool_or(is_officer) FILTER ({buy}), FALSE) AS has_officer_buys,
  count(DISTINCT insider_name) FILTER ({buy}) >= 3 AS has_cluster_buy, max(total_value) FILTER ({buy}) AS largest_single_buy,
  max(transaction_date) FILTER ({buy}) AS most_recent_buy_date, DATE '{end}' - max(transaction_date) FILTER ({buy}) AS days_since_last_buy,
  coalesce(sum(total_value) FILTER (transaction_code = 'S'), 0) AS total_sell_value, coalesce(sum(total_value) FILTER (transaction_code = 'S'), 0) >= 500000 AS has_notable_selling,
  arg_max(insider_title, (total_value, accession_number)) FILTER (transaction_code = 'S' AND total_value IS NOT NULL) AS top_seller_title
FROM {trades} WHERE transaction_code IN ('P', 'S') AND transaction_date > DATE '{end}' - 30 AND transaction_date <= DATE '{end}' GROUP BY 1""",
        trades,
    )


summary_part("summary", "trades", D)
summary_part("event_summary", "event_trades", "2024-01-31")
_SUM = (
    f"SELECT ticker, buy_count, distinct_insiders, {r8s('total_dollar_value', 4)} AS total_dollar_value, has_officer_buys, has_cluster_buy, largest_single_buy, "
    f"most_recent_buy_date, CAST(days_since_last_buy AS BIGINT) AS days_since_last_buy, {r8s('total_sell_value', 4)} AS total_sell_value, has_notable_selling, top_seller_title FROM "
)


def out_summary(df):
    return df.withColumns(
        {
            "total_dollar_value": r8("total_dollar_value", 4),
            "total_sell_value": r8("total_sell_value", 4),
            "days_since_last_buy": F.col("days_since_last_buy").cast("long"),
        }
    )


@query("insider_summary", "G-15 A-01 J-11", with_parts(_SUM + "summary", "summary"))
def _(spark, d):
    return out_summary(ins.insider_summary(inp.trades(spark, d), D))


@query("insider_summary_dense", "G-15 A-01 J-11", with_parts(_SUM + "event_summary", "event_summary"))
def _(spark, d):
    return out_summary(ins.insider_summary(inp.event_trades(spark, d), "2024-01-31"))


part(
    "ins_cat",
    """
SELECT ticker, CASE WHEN buy_count = 0 AND has_notable_selling THEN 'selling' WHEN buy_count = 0 THEN 'none' WHEN has_cluster_buy THEN 'cluster' WHEN has_officer_buys THEN 'officer' ELSE 'single' END AS category,
  concat_ws(', ', CASE WHEN has_cluster_buy THEN 'cluster' END, CASE WHEN has_officer_buys THEN 'officer' END,
    CASE WHEN total_dollar_value >= 1000000 THEN printf('$%.1fM', total_dollar_value / 1000000) WHEN total_dollar_value >= 1000 THEN printf('$%.0fK', total_dollar_value / 1000) END) AS parts, buy_count FROM summary""",
    "summary",
)


@query(
    "insider_categories",
    "G-16 X-06",
    with_parts("SELECT ticker, category, CASE WHEN buy_count = 0 THEN '' WHEN parts = '' THEN '★' ELSE '★ ' || parts END AS annotation FROM ins_cat", "ins_cat"),
)
def _(spark, d):
    s = ins.insider_summary(inp.trades(spark, d), D)
    c = F.col
    return s.select(
        "ticker",
        ins.insider_category(c("buy_count"), c("has_cluster_buy"), c("has_officer_buys"), c("has_notable_selling")).alias("category"),
        ins.insider_annotation(c("buy_count"), c("has_cluster_buy"), c("has_officer_buys"), c("total_dollar_value")).alias("annotation"),
    )


def _active(trades: str) -> str:
    return f"(SELECT *, unnest(generate_series(transaction_date, transaction_date + 29, INTERVAL 1 DAY))::DATE AS date FROM {trades} WHERE transaction_code IN ('P', 'S'))"


@query(
    "insider_scores",
    "G-17 J-05",
    with_parts(
        f"""SELECT ticker, date, CASE WHEN n >= 3 THEN 2 WHEN n >= 1 THEN 1 ELSE -1 END AS score, CASE WHEN n >= 3 THEN 'CLUSTER_BUY' WHEN n >= 1 THEN 'BUY_SIGNAL' ELSE 'SELL_SIGNAL' END AS label
FROM (SELECT ticker, date, count(DISTINCT coalesce(insider_name, '')) FILTER (is_open_market) AS n FROM {_active('event_trades')} WHERE transaction_code = 'S' OR is_open_market GROUP BY 1, 2)""",
        "event_trades",
    ),
)
def _(spark, d):
    return ins.insider_score(inp.event_trades(spark, d))


@query(
    "insider_activity",
    "G-15 J-05",
    with_parts(
        f"""SELECT ticker, date, count(*) FILTER (transaction_code = 'P' AND is_open_market) AS buy_count, count(*) FILTER (transaction_code = 'S') AS sell_count,
 count(DISTINCT insider_name) FILTER (transaction_code = 'P' AND is_open_market) AS distinct_insiders,
 {r8s("coalesce(sum(CAST(round(total_value * 100) AS BIGINT)) FILTER (transaction_code = 'P' AND is_open_market), 0) / 100.0::DOUBLE", 4)} AS total_dollar_value
FROM {_active('trades')} GROUP BY 1, 2""",
        "trades",
    ),
)
def _(spark, d):
    a = ins.insider_activity(inp.trades(spark, d))
    return a.select("ticker", "date", "buy_count", "sell_count", "distinct_insiders", r8("total_dollar_value", 4).alias("total_dollar_value"))


def _daily_summary_sql(trades: str) -> str:
    buy, cents = "transaction_code = 'P' AND coalesce(is_open_market, FALSE)", "coalesce(sum(CAST(round(total_value * 100) AS BIGINT)) FILTER ({}), 0) / 100.0::DOUBLE"
    sold = cents.format("transaction_code = 'S'")
    return with_parts(
        f"""SELECT ticker, date, count(*) FILTER ({buy}) AS buy_count, count(DISTINCT insider_name) FILTER ({buy}) AS distinct_insiders, {r8s(cents.format(buy), 4)} AS total_dollar_value,
 coalesce(bool_or(is_officer) FILTER ({buy}), FALSE) AS has_officer_buys, count(DISTINCT insider_name) FILTER ({buy}) >= 3 AS has_cluster_buy, max(total_value) FILTER ({buy}) AS largest_single_buy,
 max(transaction_date) FILTER ({buy}) AS most_recent_buy_date, date - max(transaction_date) FILTER ({buy}) AS days_since_last_buy, {r8s(sold, 4)} AS total_sell_value, {sold} >= 500000 AS has_notable_selling,
 arg_max(insider_title, (total_value, accession_number)) FILTER (transaction_code = 'S' AND total_value IS NOT NULL) AS top_seller_title
FROM {_active(f"(SELECT * REPLACE (CASE WHEN CAST(accession_number AS BIGINT) % 7 = 0 THEN NULL ELSE insider_name END AS insider_name) FROM {trades})")} GROUP BY 1, 2""",
        trades,
    )


def _some_nameless(trades):
    return trades.withColumn("insider_name", F.when(F.col("accession_number").cast("long") % 7 != 0, F.col("insider_name")))


def _daily_summary(trades):
    s = ins.insider_daily_summary(_some_nameless(trades))
    return s.withColumns({c: r8(c, 4) for c in ("total_dollar_value", "total_sell_value")})


@query("insider_daily_summary", "G-15 J-05", _daily_summary_sql("trades"))
def _(spark, d):
    return _daily_summary(inp.trades(spark, d))


@query("insider_daily_summary_dense", "G-15 J-05", _daily_summary_sql("event_trades"))
def _(spark, d):
    return _daily_summary(inp.event_trades(spark, d))


@query(
    "recent_purchases",
    "G-18 P-03",
    with_parts(
        f"""SELECT ticker, transaction_date, insider_name, total_value FROM trades WHERE transaction_code = 'P' AND is_open_market AND transaction_date > DATE '{D}' - 365 AND transaction_date <= DATE '{D}' AND total_value >= 100000""",
        "trades",
    ),
)
def _(spark, d):
    p = ins.recent_purchases(inp.trades(spark, d), D, 365, 100000.0)
    return p.select("ticker", "transaction_date", "insider_name", "total_value")


@query(
    "keys_in_all_sets",
    "J-13 T-08",
    with_parts("SELECT ticker FROM trades INTERSECT SELECT ticker FROM bars INTERSECT (SELECT parent FROM edges UNION SELECT child FROM edges)", "trades", "bars", "edges"),
)
def _(spark, d):
    from crosstide.operators.graph import universe

    return universe(inp.edges(spark, d)).intersect(inp.trades(spark, d).select("ticker")).intersect(inp.bars(spark, d).select("ticker"))


@query(
    "pairs_with_history",
    "J-09 A-02",
    with_parts(
        "SELECT parent, child FROM edges WHERE (child) IN (SELECT ticker FROM bars GROUP BY 1 HAVING count(DISTINCT date) >= 1400)",
        "edges",
        "bars",
    ),
)
def _(spark, d):
    long = inp.bars(spark, d).groupBy("ticker").agg(F.count_distinct("date").alias("n")).filter("n >= 1400")
    return inp.edges(spark, d).join(long, F.col("child") == F.col("ticker"), "left_semi").select("parent", "child")


# ---- scan ---------------------------------------------------------------------------

part(
    "feat_all",
    f"""
SELECT ticker, date, close AS price, r20, r20p, rv, CASE WHEN rn > 20 THEN rv END AS rvs, above, CASE WHEN rn >= 20 THEN (close - lo) / nullif(hi - lo, 0) * 100 END AS rng,
  CASE WHEN rn < 21 THEN '—' WHEN rn < 26 THEN '→' WHEN rv > ago * 1.10::DOUBLE THEN '↑' WHEN rv < ago * 0.90::DOUBLE THEN '↓' ELSE '→' END AS rvt,
  least(51, rn - coalesce(max(CASE WHEN NOT above THEN rn END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0)) AS days
FROM (SELECT ticker, date, close, row_number() OVER w AS rn, {ret_sql(20)} AS r20, (lag(close, 1) OVER w - lag(close, 21) OVER w) / nullif(lag(close, 21) OVER w, 0) AS r20p,
  volume / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rv,
  lag(volume, 5) OVER w / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 25 PRECEDING AND 6 PRECEDING) AS ago,
  row_number() OVER w > 50 AND close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS above,
  min(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS lo, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hi
  FROM all_bars {W})""",
    "all_bars",
)
part("snap", f"SELECT * FROM feat_all WHERE date <= DATE '{D}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1", "feat_all")
part(
    "newest_est",
    "SELECT ticker, (analysts_up - analysts_down) / nullif(analysts_up + analysts_down, 0)::DOUBLE AS est_rev FROM estimates QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1",
    "estimates",
)
part("next_ev", f"SELECT ticker, min(transaction_date) - DATE '{D}' AS days FROM trades WHERE transaction_date >= DATE '{D}' AND is_officer GROUP BY 1", "trades")
part(
    "zsnap",
    "SELECT t.theme, t.ticker, CASE WHEN count(r20) OVER g >= 3 THEN (r20 - avg(r20) OVER g) / nullif(stddev_pop(r20) OVER g, 0) END AS z FROM themes t LEFT JOIN snap USING (ticker) WINDOW g AS (PARTITION BY theme)",
    "themes",
    "snap",
)
_ARROW = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN '—' WHEN {a} > {b} + 0.01::DOUBLE THEN '↑' WHEN {a} < {b} - 0.01::DOUBLE THEN '↓' ELSE '→' END"
_CONFIRM = "(coalesce(rs_score > 0, FALSE)::INT + coalesce({rv} >= 1.5::DOUBLE, FALSE)::INT + coalesce(est_rev > 0, FALSE)::INT + (coalesce(buy_count, 0) > 0)::INT + coalesce({up}, FALSE)::INT)"
part(
    "scan_rows",
    f"""
SELECT q.*, row_number() OVER (PARTITION BY parent ORDER BY rs_score DESC, ticker) AS pos, count(*) OVER (PARTITION BY parent) AS n_children,
  rank() OVER (ORDER BY rs_score DESC) AS rank, count(*) OVER () AS total, (rank() OVER (ORDER BY rs_score) - 1) / CAST(count(*) OVER () AS DOUBLE) AS pct,
  CASE WHEN parent_ret > 0 THEN 'UP' WHEN parent_ret >= -0.05::DOUBLE THEN 'MILD_PULLBACK' WHEN parent_ret >= -0.15::DOUBLE THEN 'CORRECTION' ELSE 'DRAWDOWN' END AS regime
FROM (SELECT c.ticker, e.parent, (c.r20 - p.r20) * weight AS rs_score, c.r20 AS own_ret, p.r20 AS parent_ret, {_ARROW.format(a='(c.r20 - p.r20)', b='(c.r20p - p.r20p)')} AS rs_trend,
  c.price, c.rv, c.above, c.rng, c.rvt, c.days
  FROM edges e JOIN snap c ON c.ticker = e.child JOIN snap p ON p.ticker = e.parent) q WHERE rs_score IS NOT NULL""",
    "edges",
    "snap",
)
part(
    "scan_betas",
    f"""
SELECT k.ticker, covar_samp(t.r, m.m) / nullif(var_samp(m.m), 0) AS beta FROM (SELECT ticker, max(ti) AS ti FROM tret WHERE date <= DATE '{D}' GROUP BY 1) k
JOIN tret t ON t.ticker = k.ticker AND t.ti BETWEEN k.ti - 59 AND k.ti JOIN mret m ON m.mi = (SELECT max(mi) FROM mret WHERE date <= DATE '{D}') - (k.ti - t.ti)
WHERE k.ti > 60 GROUP BY 1 HAVING count(t.r) = 60 AND count(m.m) = 60""",
    "tret",
    "mret",
)
part("m_snap", f"SELECT m FROM mr20 WHERE date <= DATE '{D}' ORDER BY date DESC LIMIT 1", "mr20")
part(
    "scan",
    f"""
SELECT s.parent, s.regime AS parent_regime, s.parent_ret AS parent_20d_return, r.parent IS NOT NULL AS is_tradeable, s.parent IN ('NATION_0','NATION_1','NATION_2') AS is_validated,
  CASE WHEN pos <= 3 THEN 'top' ELSE 'bottom' END AS section, pos, s.ticker, s.price, rs_score, rank, total,
  CASE WHEN s.parent NOT IN ('NATION_0','NATION_1','NATION_2') THEN 'WAIT - unvalidated' WHEN r.parent IS NULL THEN 'WAIT'
    WHEN pct >= 0.8::DOUBLE THEN 'STRONG_BUY' WHEN pct >= 0.6::DOUBLE THEN 'BUY' WHEN pct >= 0.2::DOUBLE THEN 'HOLD' ELSE 'SELL' END AS action_label,
  est_rev, s.rv AS rvol, {_CONFIRM.format(rv='s.rv', up='s.above')} AS confirm, coalesce(category, 'none') AS insider_annotation, coalesce(distinct_insiders, 0) AS distinct_insiders,
  s.above AS above_50ma, n.days AS earnings_days, s.rvt AS rvol_trend, rs_trend, s.days AS days_above_50ma, s.rng AS price_range_pct, z AS z_score,
  ((s.own_ret - cb.beta * m) - (s.parent_ret - pb.beta * m)) AS rs_adj
FROM scan_rows s LEFT JOIN (VALUES ('NATION_0','CORRECTION'),('NATION_1','CORRECTION'),('NATION_1','MILD_PULLBACK'),('NATION_2','UP'),('NATION_2','CORRECTION')) r(parent, regime) ON r.parent = s.parent AND r.regime = s.regime
LEFT JOIN summary u ON u.ticker = s.ticker LEFT JOIN (SELECT ticker, category FROM ins_cat) k ON k.ticker = s.ticker LEFT JOIN newest_est e ON e.ticker = s.ticker LEFT JOIN next_ev n ON n.ticker = s.ticker
LEFT JOIN zsnap z ON z.ticker = s.ticker LEFT JOIN scan_betas cb ON cb.ticker = s.ticker LEFT JOIN scan_betas pb ON pb.ticker = s.parent CROSS JOIN m_snap
WHERE pos <= 3 OR pos > n_children - 3""",
    "scan_rows",
    "summary",
    "ins_cat",
    "newest_est",
    "next_ev",
    "zsnap",
    "scan_betas",
    "m_snap",
)


def events(spark, d):
    e = inp.trades(spark, d).filter("is_officer").select("ticker", F.col("transaction_date").alias("date"))
    return tb.next_event(e, D)


def scan(spark, d):
    allb = inp.series(spark, d, "nation", "market")
    own, market = allb.filter(F.col("ticker") != inp.MARKET), allb.filter(F.col("ticker") == inp.MARKET)
    return sc.scan(
        own,
        inp.edges(spark, d),
        inp.trades(spark, d),
        tb.revision_score(inp.estimates(spark, d)),
        events(spark, d),
        inp.themes(spark, d),
        market,
        sc.regime_table(spark, inp.REGIMES),
        inp.VALIDATED,
        D,
    )


_SCAN_TEXT = "parent, parent_regime, is_tradeable, is_validated, section, pos, ticker, rank, total, action_label, insider_annotation, distinct_insiders, above_50ma, rvol_trend, rs_trend, price"
_SCAN_NUM = ("parent_20d_return", "rs_score", "rs_adj", "est_rev", "rvol", "price_range_pct", "z_score")


@query(
    "dependent_scan",
    "G-21 G-09 J-16",
    with_parts(
        f"SELECT DATE '{D}' AS scan_date, {_SCAN_TEXT}, {', '.join(f'{r8s(c, 6)} AS {c}' for c in _SCAN_NUM)}, confirm, CAST(earnings_days AS BIGINT) AS earnings_days, CAST(days_above_50ma AS BIGINT) AS days_above_50ma FROM scan",
        "scan",
    ),
)
def _(spark, d):
    return scan(spark, d).withColumns({c: r8(c, 6) for c in _SCAN_NUM})


@query(
    "theme_scan",
    "G-23 G-06",
    with_parts(
        f"""SELECT DATE '{D}' AS scan_date, theme, ticker, theme_label, benchmark, price, {r8s('rs_score')} AS rs_score, rs_trend, {r8s('rvs')} AS rvol, rvol_trend,
  {_CONFIRM.format(rv='rvs', up='days_above_50ma > 0')} AS confirm, CAST(days_above_50ma AS BIGINT) AS days_above_50ma, {r8s('rng')} AS price_range_pct, {r8s('est_rev')} AS est_rev,
  CASE WHEN coalesce(buy_count, 0) = 0 THEN NULL WHEN parts = '' THEN '★' ELSE '★ ' || parts END AS insider_annotation, CAST(edays AS BIGINT) AS earnings_days, theme_active,
  CASE WHEN theme IN ('africa', 'asia') THEN CASE WHEN z IS NULL THEN 'WATCH' WHEN z > 1.5::DOUBLE THEN 'STRONG_BUY(z)' WHEN z > 0.5::DOUBLE THEN 'BUY(z)' WHEN z > -0.5::DOUBLE THEN 'HOLD(z)' ELSE 'SELL(z)' END
   WHEN theme IN ('europe', 'america') THEN CASE WHEN rs_score IS NULL THEN 'WATCH' WHEN rs_score >= 0.15::DOUBLE THEN 'STRONG_BUY' WHEN rs_score >= 0.05::DOUBLE THEN 'BUY' WHEN rs_score >= -0.05::DOUBLE THEN 'HOLD' ELSE 'SELL' END
   ELSE 'WATCH' END AS action_label, {r8s('z', 6)} AS z_score
FROM (SELECT t.*, s.price, s.r20 - b.r20 AS rs_score, {_ARROW.format(a='(s.r20 - b.r20)', b='(s.r20p - b.r20p)')} AS rs_trend, s.rvs, coalesce(s.rvt, '—') AS rvol_trend, coalesce(s.days, 0) AS days_above_50ma, s.rng,
   est_rev, u.buy_count, k.parts, n.days AS edays, z, CASE WHEN b.r20 - m.r20 IS NULL THEN 'UNKNOWN' WHEN b.r20 - m.r20 > 0 THEN 'ACTIVE' WHEN b.r20 - m.r20 >= -0.02::DOUBLE THEN 'NEUTRAL' ELSE 'INACTIVE' END AS theme_active
  FROM themes t LEFT JOIN snap s ON s.ticker = t.ticker LEFT JOIN snap b ON b.ticker = t.benchmark LEFT JOIN snap m ON m.ticker = 'MARKET' LEFT JOIN summary u ON u.ticker = t.ticker
  LEFT JOIN ins_cat k ON k.ticker = t.ticker LEFT JOIN newest_est e ON e.ticker = t.ticker LEFT JOIN next_ev n ON n.ticker = t.ticker LEFT JOIN zsnap z ON z.ticker = t.ticker)""",
        "themes",
        "snap",
        "summary",
        "ins_cat",
        "newest_est",
        "next_ev",
        "zsnap",
    ),
)
def _(spark, d):
    themes = inp.themes(spark, d)
    z = [f"NATION_{i}" for i in range(25) if i % 5 in (0, 2)]
    rs = [f"NATION_{i}" for i in range(25) if i % 5 in (1, 3)]
    t = sc.theme_scan(
        inp.series(spark, d, "nation", "region", "market"),
        themes,
        themes,
        inp.trades(spark, d),
        tb.revision_score(inp.estimates(spark, d)),
        events(spark, d),
        inp.MARKET,
        D,
        z,
        rs,
    )
    return t.withColumns(
        {c: r8(c) for c in ("rs_score", "rvol", "price_range_pct", "est_rev")}
        | {"z_score": r8("z_score", 6), "earnings_days": F.col("earnings_days").cast("long"), "days_above_50ma": F.col("days_above_50ma").cast("long")}
    )


@query(
    "member_confirmation",
    "G-09 G-11",
    with_parts(
        f"""SELECT m.ticker, m.date, (coalesce(d0_20 > 0, FALSE)::INT + coalesce(CASE WHEN rn > 21 THEN rv END >= 1.5::DOUBLE, FALSE)::INT + coalesce(trend_raw >= 2, FALSE)::INT) AS confirm
FROM mcomp m JOIN (SELECT ticker, date, volume / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rv FROM aligned) v USING (ticker, date)""",
        "mcomp",
        "aligned",
    ),
)
def _(spark, d):
    c = sg.megacap_composite(aligned(spark, d))
    none = F.lit(None).cast("double")
    return c.select(
        "ticker",
        "date",
        sg.confirm_live(F.col("rs_0_20"), F.col("rvol"), none, F.lit(False), F.col("trend_raw"), kind="megacap").alias("confirm"),
    )


# ---- journal ------------------------------------------------------------------------

part(
    "journal",
    f"""
SELECT DATE '{D}' AS scan_date, ticker, parent, parent_regime, price, rs_score, printf('(%d/%d)', rank, total) AS rank, action_label, confirm, insider_annotation,
  CASE WHEN insider_annotation = 'cluster' THEN printf('%d insiders bought %s in last 30d; not actionable until %s pulls back.', distinct_insiders, ticker, parent) ELSE '' END AS notes FROM scan""",
    "scan",
)


@query(
    "captured_journal",
    "G-24",
    with_parts(f"SELECT scan_date, ticker, parent, parent_regime, price, {r8s('rs_score')} AS rs_score, rank, action_label, confirm, insider_annotation, notes FROM journal", "journal"),
)
def _(spark, d):
    rows = scan(spark, d)
    j = jr.capture_journal(rows, jr.journal_rows(rows).limit(0))
    return j.select("scan_date", "ticker", "parent", "parent_regime", "price", r8("rs_score").alias("rs_score"), "rank", "action_label", "confirm", "insider_annotation", "notes")


@query(
    "recaptured_journal",
    "G-24",
    with_parts(
        "SELECT 'skip' AS mode, scan_date, ticker, parent, 'kept' AS notes FROM journal UNION ALL SELECT 'force', scan_date, ticker, parent, notes FROM journal",
        "journal",
    ),
)
def _(spark, d):
    rows = scan(spark, d)
    before = jr.journal_rows(rows).withColumn("notes", F.lit("kept"))
    modes = [(F.lit("skip"), jr.capture_journal(rows, before)), (F.lit("force"), jr.capture_journal(rows, before, force=True))]
    skip, force = [j.select(m.alias("mode"), "scan_date", "ticker", "parent", "notes") for m, j in modes]
    return skip.union(force)


@query(
    "restored_scan",
    "S-20 X-12",
    with_parts(f"SELECT DATE '{D}' AS scan_date, parent, pos, ticker, action_label, {r8s('rs_score')} AS rs_score FROM scan", "scan"),
)
def _(spark, d):
    rows = scan(spark, d).select("scan_date", "parent", "pos", "ticker", "action_label", "rs_score")
    back = jr.read_scan(jr.persist_scan(rows), "parent string, pos bigint, ticker string, action_label string, rs_score double")
    return back.select("scan_date", "parent", "pos", "ticker", "action_label", r8("rs_score").alias("rs_score"))


part(
    "label_journal",
    """
SELECT date AS scan_date, ticker, parent, action AS action_label, price FROM (SELECT s.*, b.close AS price FROM wf_obs s ASOF JOIN bars b ON b.ticker = s.ticker AND s.date >= b.date)""",
    "wf_obs",
    "bars",
)
part("jp_px", "SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx, close FROM bars", "bars")


def label_journal(spark, d):
    from crosstide.operators.asof import asof_join
    from crosstide.plans.backtests import walk_forward_obs

    b = inp.bars(spark, d)
    obs = walk_forward_obs(b, inp.edges(spark, d))
    rows = asof_join(obs.select("ticker", "parent", "date", "action"), b.select("ticker", "date", "close"), ["ticker"], "date", ["close"])
    return rows.select(
        F.col("date").alias("scan_date"), "ticker", "parent", F.col("action").alias("action_label"), F.col("close").alias("price")
    )


@query(
    "journal_performance",
    "G-25 A-03",
    with_parts(
        f"""SELECT action_label, count(*) AS count, {r8s('avg(r5)')} AS avg_5d, {r8s('avg(r10)')} AS avg_10d, {r8s('avg(r20)')} AS avg_20d, {r8s('avg((r10 > 0)::INT)')} AS hit_rate_10d, count(r10) AS n_with_returns
FROM (SELECT action_label, (x5.close - price) / price AS r5, (x10.close - price) / price AS r10, (x20.close - price) / price AS r20
 FROM (SELECT j.*, p.idx FROM label_journal j ASOF JOIN jp_px p ON p.ticker = j.ticker AND j.scan_date >= p.date) q
 LEFT JOIN jp_px x5 ON x5.ticker = q.ticker AND x5.idx = q.idx + 5 LEFT JOIN jp_px x10 ON x10.ticker = q.ticker AND x10.idx = q.idx + 10 LEFT JOIN jp_px x20 ON x20.ticker = q.ticker AND x20.idx = q.idx + 20)
GROUP BY 1""",
        "label_journal",
        "jp_px",
    ),
)
def _(spark, d):
    p = jr.journal_performance(label_journal(spark, d), inp.bars(spark, d))
    return p.withColumns({c: r8(c) for c in ("avg_5d", "avg_10d", "avg_20d", "hit_rate_10d")})


@query(
    "recent_journal_rows",
    "T-09",
    with_parts("SELECT scan_date, ticker, parent, action_label FROM label_journal ORDER BY scan_date DESC, parent, ticker LIMIT 200", "label_journal"),
)
def _(spark, d):
    return jr.recent_journal(label_journal(spark, d)).select("scan_date", "ticker", "parent", "action_label")


@query(
    "latest_journal_rows",
    "J-12",
    with_parts("SELECT scan_date, ticker, parent, action_label FROM label_journal QUALIFY row_number() OVER (PARTITION BY ticker, parent ORDER BY scan_date DESC) = 1", "label_journal"),
)
def _(spark, d):
    return jr.latest_entries(label_journal(spark, d)).select("scan_date", "ticker", "parent", "action_label")


part(
    "notes",
    """
SELECT CAST(accession_number AS BIGINT) AS id, transaction_date AS observation_date, insider_title AS type, ticker AS primary_ticker,
  CASE WHEN is_officer THEN 'NATION_7,NATION_9' WHEN is_director THEN 'NATION_6, ' || ticker END AS affected_tickers, insider_name AS note FROM trades""",
    "trades",
)


def notes(spark, d):
    return inp.trades(spark, d).select(
        F.col("accession_number").cast("long").alias("id"),
        F.col("transaction_date").alias("observation_date"),
        F.col("insider_title").alias("type"),
        F.col("ticker").alias("primary_ticker"),
        F.when(F.col("is_officer"), "NATION_7,NATION_9")
        .when(F.col("is_director"), F.concat(F.lit("NATION_6, "), "ticker"))
        .alias("affected_tickers"),
        F.col("insider_name").alias("note"),
    )


def _annotated(mode: str) -> str:
    key = "observation_date" if mode == "date" else "latest"
    return f"""WITH fan AS (SELECT DISTINCT id, observation_date, t AS ticker, '[' || type || '] ' || note AS txt FROM notes, unnest(list_distinct([primary_ticker] || coalesce(list_transform(string_split(affected_tickers, ','), lambda x: trim(x)), []))) u(t)),
j AS (SELECT *, 'n' || parent AS notes, max(scan_date) OVER (PARTITION BY ticker) AS latest FROM label_journal),
a AS (SELECT {'f.observation_date' if mode == 'date' else 'l.latest'} AS scan_date, f.ticker, string_agg(txt, ' | ' ORDER BY id) AS add FROM fan f {'' if mode == 'date' else 'JOIN (SELECT DISTINCT ticker, latest FROM j) l ON l.ticker = f.ticker'} GROUP BY 1, 2)
SELECT j.scan_date, j.ticker, j.parent, CASE WHEN a.add IS NULL THEN j.notes ELSE j.notes || ' | ' || a.add END AS notes FROM j LEFT JOIN a ON a.scan_date = j.scan_date AND a.ticker = j.ticker"""


@query("journal_notes_by_date", "J-15", with_parts(_annotated("date"), "notes", "label_journal"))
def _(spark, d):
    j = label_journal(spark, d).select("scan_date", "ticker", "parent", F.concat(F.lit("n"), "parent").alias("notes"))
    return jr.annotate_journal(j, notes(spark, d), "date")


@query("journal_notes_latest", "J-15", with_parts(_annotated("latest"), "notes", "label_journal"))
def _(spark, d):
    j = label_journal(spark, d).select("scan_date", "ticker", "parent", F.concat(F.lit("n"), "parent").alias("notes"))
    return jr.annotate_journal(j, notes(spark, d), "latest")


def _note_rows_sql(mode: str) -> str:
    head, _, _ = _annotated(mode).partition("\na AS (")
    return f"""{head}
k AS (SELECT DISTINCT scan_date, ticker, latest FROM j),
n AS (SELECT f.id, f.ticker, {'f.observation_date' if mode == 'date' else 'k.latest'} AS scan_date, txt AS text FROM fan f {'' if mode == 'date' else 'JOIN (SELECT DISTINCT ticker, latest FROM k) k ON k.ticker = f.ticker'} WHERE txt IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY scan_date, ticker ORDER BY id) AS pos FROM n)
SELECT scan_date, ticker, parent, pos, id, text FROM j JOIN p USING (scan_date, ticker)"""


@query("journal_note_rows_by_date", "J-15", with_parts(_note_rows_sql("date"), "notes", "label_journal"))
def _(spark, d):
    return jr.journal_note_rows(label_journal(spark, d), notes(spark, d), "date")


@query("journal_note_rows_latest", "J-15", with_parts(_note_rows_sql("latest"), "notes", "label_journal"))
def _(spark, d):
    return jr.journal_note_rows(label_journal(spark, d), notes(spark, d), "latest")


# ---- divergence history and feeds ---------------------------------------------------


@query(
    "divergence_outcomes",
    "G-14 J-03 J-04",
    with_parts(
        """SELECT f.date, f.ticker, f.strength, f.divergence_vs_benchmark, round(CASE WHEN b.close > 0 THEN (x.close - b.close) / b.close * 100 END, 2) AS outcome_5d
FROM (SELECT * FROM flags WHERE date >= DATE '2000-01-01' - 365) f ASOF LEFT JOIN jp_px b ON b.ticker = f.ticker AND f.date >= b.date LEFT JOIN jp_px x ON x.ticker = f.ticker AND x.idx = b.idx + 5""",
        "flags",
        "jp_px",
    ),
)
def _(spark, d):
    o = jr.divergence_outcomes(flags(spark, d), inp.bars(spark, d), "2000-01-01", 365)
    return o.select("date", "ticker", "strength", "divergence_vs_benchmark", "outcome_5d")


@query(
    "filings_feed",
    "G-29 T-05",
    with_parts(
        f"""SELECT ticker, is_megacap, id, filed_date, impact, filing_count FROM (SELECT f.*, p.parent IS NOT NULL AS is_megacap, count(*) OVER (PARTITION BY f.ticker) AS filing_count
FROM stored_filings f LEFT JOIN (SELECT DISTINCT parent FROM edges) p ON p.parent = f.ticker WHERE filed_date >= DATE '{D}' - 30 AND (p.parent IS NOT NULL OR f.ticker IN (SELECT child FROM edges)))""",
        "stored_filings",
        "edges",
    ),
)
def _(spark, d):
    e = inp.edges(spark, d)
    mega = e.select(F.col("parent").alias("ticker"), F.lit(True).alias("is_megacap")).distinct()
    names = mega.unionByName(e.select(F.col("child").alias("ticker"), F.lit(False).alias("is_megacap")).distinct())
    feed = sc.filings_feed(ql.stored_filings(spark, d), names, D, 30)
    return feed.select("ticker", "is_megacap", "id", "filed_date", "impact", "filing_count")
