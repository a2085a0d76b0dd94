"""Research comparisons of signal variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.operators import features as ft
from crosstide.operators.ic import guarded_corr, pivot_halves, spearman, with_all, with_date_half, with_row_half
from crosstide.operators.ranking import research_regime, xs_zscore
from crosstide.plans.backtests import stability

BLUME_SLOPE, BLUME_INTERCEPT = 0.67, 0.33


def largest_moves(bars: DataFrame, ticker: str, n: int = 10) -> DataFrame:
    """The ``n`` largest absolute one-row moves of one series."""
    moves = bars.filter(F.col("ticker") == ticker).select("date", ft.ret(1).alias("move"))
    return moves.filter(F.col("move").isNotNull()).orderBy(F.desc(F.abs("move")), "date").limit(n)


# ---- baskets ------------------------------------------------------------------------


def basket_features(bars: DataFrame, baskets: DataFrame, horizon: int = 20, min_members: int = 3) -> DataFrame:
    """Members trading that day: 20-row return, its z-score, relative volume and forward return.

    A basket with fewer tickers than ``min_members`` needs all of its own.
    """
    feats = bars.select(
        "ticker",
        "date",
        ft.ret(20).alias("ret"),
        F.when(ft.rows_seen() > 20, ft.rvol(20, "lenient")).alias("rvol"),
        ft.forward_return(horizon, "signal_close").alias("fwd"),
    )
    size = baskets.groupBy("theme").agg(F.least(F.lit(min_members), F.count_distinct("ticker")).alias("_need"))
    rows = feats.join(baskets, "ticker").join(size, "theme").filter(F.col("ret").isNotNull())
    have = rows.groupBy("theme", "date").agg(F.count(F.lit(1)).alias("_have"))
    rows = rows.join(have, ["theme", "date"]).filter(F.col("_have") >= F.col("_need")).drop("_have", "_need")
    z = xs_zscore(rows, ["theme", "date"], "ret", "z_rs", 1)
    return z.withColumn("combined", F.col("z_rs") * F.col("rvol"))


def blume_signals(bars: DataFrame, baskets: DataFrame, market: DataFrame, beta_window: int = 60) -> DataFrame:
    """Basket z-score with beta variants: z of raw and of shrunken beta, and their products.

    Betas pair returns by position and need the market to trade that day. Rows without a
    defined z-score or forward return are left out. ``baskets`` has theme, ticker, position.
    """
    rows = basket_features(bars, baskets).filter(F.col("z_rs").isNotNull())
    beta = ft.with_beta(bars.select("ticker", "date", ft.PRICE), market, beta_window, "position").select("ticker", "date", "beta")
    beta = beta.join(market.select("date"), "date", "left_semi")
    rows = rows.join(beta, ["ticker", "date"], "left").withColumn("beta_blume", F.col("beta") * BLUME_SLOPE + BLUME_INTERCEPT)
    rows = xs_zscore(rows, ["theme", "date"], "beta", "z_beta", 2)
    rows = xs_zscore(rows, ["theme", "date"], "beta_blume", "z_blume", 2)
    return rows.filter(F.col("fwd").isNotNull()).select(
        "theme",
        "ticker",
        "position",
        "date",
        "z_rs",
        "rvol",
        F.col("beta").alias("beta_raw"),
        "beta_blume",
        "z_beta",
        "z_blume",
        F.col("combined").alias("combined_base"),
        (F.col("combined") * F.col("z_beta")).alias("combined_beta"),
        (F.col("combined") * F.col("z_blume")).alias("combined_blume"),
        "fwd",
    )


def beta_diagnostics(bars: DataFrame, baskets: DataFrame, market: DataFrame, beta_window: int = 60) -> DataFrame:
    """Betas of every basket on the latest date all its members and the market trade."""
    own = bars.join(baskets.select("ticker", "theme").distinct(), "ticker")
    size = baskets.groupBy("theme").agg(F.count_distinct("ticker").alias("_n"))
    both = own.join(market.select("date"), "date", "left_semi").groupBy("theme", "date").agg(F.count_distinct("ticker").alias("_k"))
    latest = both.join(size, "theme").filter(F.col("_k") == F.col("_n")).groupBy("theme").agg(F.max("date").alias("date"))
    beta = ft.with_beta(bars.select("ticker", "date", ft.PRICE), market, beta_window, "position").select("ticker", "date", "beta")
    rows = baskets.select("theme", "ticker").join(latest, "theme").join(beta, ["ticker", "date"], "left")
    rows = rows.withColumn("beta_blume", F.col("beta") * BLUME_SLOPE + BLUME_INTERCEPT)
    rows = xs_zscore(rows, ["theme"], "beta", "z_beta", 2)
    return xs_zscore(rows, ["theme"], "beta_blume", "z_blume", 2)


VARIANTS = {"base": "combined_base", "beta": "combined_beta", "blume": "combined_blume"}


def beta_variant_ics(obs: DataFrame, min_n: int = 30) -> DataFrame:
    """IC of each variant per basket, full and by date half, with its stability."""
    rows = with_date_half(obs, ["theme"])
    items = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("score")) for n, c in VARIANTS.items()])
    long = with_all(rows.withColumn("_v", F.explode(items)).select("theme", "date", "position", "half", "fwd", "_v.variant", "_v.score"))
    ics = spearman(long, ["theme", "variant", "half"], "ordinal", min_n, ("date", "position"), pooled=True)
    wide = pivot_halves(ics, ["theme", "variant"])
    return wide.withColumn("stable", stability(F.col("ic_h1"), F.col("ic_h2")))


def beta_variant_recommendation(ics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winner per basket with its gain over the base, one row with the overall verdict)."""
    order = F.when(F.col("variant") == "base", 0).when(F.col("variant") == "beta", -1).otherwise(-2)
    base = F.max(F.when(F.col("variant") == "base", F.struct("ic", "ic_h2")))
    best = F.max_by(F.struct("variant", "ic", "ic_h2"), F.when(F.col("ic").isNotNull(), F.struct("ic", order)))
    per = ics.groupBy("theme").agg(base.alias("_b"), best.alias("_w")).filter(F.col("_w.ic").isNotNull())
    winners = per.select(
        "theme",
        F.col("_w.variant").alias("winner"),
        (F.col("_w.ic") - F.col("_b.ic")).alias("gain"),
        F.coalesce(F.col("_w.ic_h2") > F.col("_b.ic_h2"), F.lit(False)).alias("h2_improved"),
    )
    n, mean = F.count("gain"), F.avg("gain")
    better = F.count(F.when(F.col("h2_improved"), 1))
    verdict = winners.agg(
        mean.alias("mean_gain"),
        better.alias("h2_improved"),
        n.alias("n_baskets"),
        F.when(n == 0, "INSUFFICIENT DATA").when((mean > 0.01) & (better >= n / 2), "YES").otherwise("NO").alias("verdict"),
    )
    return winners, verdict


def basket_research(bars: DataFrame, baskets: DataFrame, min_halves: int = 40) -> DataFrame:
    """IC of strength, z and z times volume per member and for the whole basket.

    ``baskets`` has theme, ticker, benchmark and position. Halves of the combined signal
    go by row: date order for a member, member after member for the basket.
    """
    rows = basket_features(bars, baskets).filter(F.col("fwd").isNotNull())
    b = bars.select(F.col("ticker").alias("benchmark"), "date", ft.ret(20).alias("_b"))
    rows = rows.join(b, ["benchmark", "date"], "left").withColumn("rs", F.col("ret") - F.col("_b"))
    items = F.array(
        F.struct(F.lit("rs").alias("signal"), F.col("rs").alias("score")),
        F.struct(F.lit("z").alias("signal"), F.col("z_rs").alias("score")),
        F.struct(F.lit("combined").alias("signal"), F.col("combined").alias("score")),
    )
    long = (
        rows.withColumn("_s", F.explode(items))
        .withColumn("name", F.explode(F.array(F.col("ticker"), F.lit("BASKET"))))
        .select("theme", "name", "position", "date", "fwd", "_s.signal", "_s.score")
        .filter(F.col("score").isNotNull())
    )
    # a basket is a handful of members times the trading calendar
    keys = ["theme", "name", "signal"]
    halves = with_all(with_row_half(long, keys, ["position", "date"]))
    ics = pivot_halves(spearman(halves, [*keys, "half"], "ordinal", 5, ("position", "date"), pooled=True), keys)
    enough = (F.col("signal") == "combined") & (F.col("n") >= min_halves)
    out = ics.withColumns({c: F.when(enough, F.col(c)) for c in ("ic_h1", "ic_h2")})
    passed = F.coalesce((F.col("ic_h1") > 0.05) & (F.col("ic_h2") > 0.05), F.lit(False))
    return out.withColumn("validated", (F.col("name") == "BASKET") & passed)


# ---- raw against adjusted strength --------------------------------------------------


def raw_adjusted_obs(bars: DataFrame, pairs: DataFrame, market: DataFrame, horizon: int = 20, beta_window: int = 60) -> DataFrame:
    """Raw and beta-adjusted strength on dates child, parent and market all trade.

    Betas pair own one-row returns on shared dates. Returns run from the signal close.
    """
    px = bars.select("ticker", "date", ft.PRICE)
    feats = px.select("ticker", "date", ft.ret(20).alias("r"), ft.forward_return(horizon, "signal_close").alias("fwd"))
    beta = ft.with_beta(px, market, beta_window, "date").select("ticker", "date", "beta")
    feats = feats.join(beta, ["ticker", "date"], "left")
    m = market.select(F.lit("m").alias("ticker"), "date", ft.PRICE).select("date", ft.ret(20).alias("m"))
    parent = feats.select(F.col("ticker").alias("parent"), "date", F.col("r").alias("p_r"), F.col("beta").alias("p_beta"))
    rows = feats.join(pairs.select("ticker", "parent").distinct(), "ticker").join(parent, ["parent", "date"]).join(m, "date")
    rows = rows.filter(F.col("fwd").isNotNull() & F.col("r").isNotNull() & F.col("p_r").isNotNull())
    adj = (F.col("r") - F.col("beta") * F.col("m")) - (F.col("p_r") - F.col("p_beta") * F.col("m"))
    return rows.select(
        "ticker", "parent", "date", (F.col("r") - F.col("p_r")).alias("raw"), adj.alias("adj"), "fwd", F.col("p_r").alias("parent_20d"),
        F.when(adj.isNotNull(), F.col("beta")).alias("beta"),
    )


def _winner(raw: Column, adj: Column, raw_gap: Column, adj_gap: Column) -> Column:
    """Larger absolute IC; within 0.01 the smaller gap between halves."""
    diff = F.abs(adj) - F.abs(raw)
    close = F.when(raw_gap.isNull() | adj_gap.isNull(), "Tie").when(adj_gap < raw_gap, "Adj").otherwise("Raw")
    return F.when(raw.isNull() | adj.isNull(), "n/a").when(F.abs(diff) < 0.01, close).when(diff > 0, "Adj").otherwise("Raw")


def _signals_long(obs: DataFrame) -> DataFrame:
    items = F.array(
        F.struct(F.lit("raw").alias("signal"), F.col("raw").alias("score")),
        F.struct(F.lit("adj").alias("signal"), F.col("adj").alias("score")),
    )
    rest = [c for c in obs.columns if c not in ("raw", "adj")]
    return obs.withColumn("_s", F.explode(items)).select(*rest, "_s.signal", "_s.score").filter(F.col("score").isNotNull())


def raw_vs_adjusted(obs: DataFrame) -> DataFrame:
    """Per pair: ICs and halves of both signals, stability gaps, correlation, mean beta and the winner."""
    keys = ["ticker", "parent"]
    long = with_all(with_row_half(_signals_long(obs), [*keys, "signal"]))
    ics = pivot_halves(spearman(long, [*keys, "signal", "half"], "average", 5), [*keys, "signal"])
    at = lambda s, c: F.max(F.when(F.col("signal") == s, F.col(c)))
    wide = ics.groupBy(*keys).agg(
        *[at(s, c).alias(f"{s}_{c}") for s in ("raw", "adj") for c in ("n", "ic", "ic_h1", "ic_h2")]
    ).filter(F.col("raw_n").isNotNull() & F.col("adj_n").isNotNull())
    for s in ("raw", "adj"):
        wide = wide.withColumn(f"{s}_gap", F.abs(F.col(f"{s}_ic_h2") - F.col(f"{s}_ic_h1")))
    both = obs.filter(F.col("adj").isNotNull()).groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 5, guarded_corr(F.col("raw"), F.col("adj"))).alias("signal_corr"), F.avg("beta").alias("avg_beta")
    )
    out = wide.join(both, keys)
    return out.withColumn("winner", _winner(F.col("raw_ic"), F.col("adj_ic"), F.col("raw_gap"), F.col("adj_gap")))


def regime_comparison(obs: DataFrame, min_n: int = 30) -> DataFrame:
    """ICs of both signals per pair and six-way parent regime; small regimes keep NULL."""
    keys = ["ticker", "parent", "regime"]
    rows = obs.filter(F.col("adj").isNotNull()).withColumn("regime", research_regime(F.col("parent_20d")))
    ics = spearman(_signals_long(rows), [*keys, "signal"], "average", min_n)
    at = lambda s, c: F.max(F.when(F.col("signal") == s, F.col(c)))
    wide = ics.groupBy(*keys).agg(at("adj", "n").alias("n"), at("raw", "ic").alias("raw_ic"), at("adj", "ic").alias("adj_ic"))
    none = F.lit(None).cast("double")
    return wide.withColumn("winner", F.when(F.col("n") < min_n, "insufficient").otherwise(_winner(F.col("raw_ic"), F.col("adj_ic"), none, none)))


def keep_verdict(comparison: DataFrame, regimes: DataFrame) -> DataFrame:
    """Whether an edge earns its place by its adjusted IC, overall or in correction."""
    c = regimes.filter(F.col("regime") == "CORRECTION").select("ticker", "parent", F.col("adj_ic").alias("corr_ic"))
    adj, corr = F.col("adj_ic"), F.col("corr_ic")
    verdict = (
        F.when(adj.isNull(), "INSUFFICIENT DATA")
        .when(adj > 0.10, "KEEP")
        .when(corr > 0.10, "KEEP (regime value)")
        .when((adj < 0.05) & (corr.isNull() | (corr < 0.05)), "CONSIDER DROPPING")
        .otherwise("MARGINAL")
    )
    return comparison.select("ticker", "parent", "adj_ic").join(c, ["ticker", "parent"], "left").withColumn("verdict", verdict)


def macro_shift_days(obs: DataFrame, market: DataFrame, n: int = 10) -> DataFrame:
    """Both signals of every pair on the market's ``n`` largest moves."""
    moves = largest_moves(market.withColumn("ticker", F.lit("m")), "m", n)
    rows = obs.filter(F.col("adj").isNotNull()).select("ticker", "parent", "date", "raw", "adj")
    return rows.join(moves, "date").withColumn("diff", F.col("raw") - F.col("adj"))
