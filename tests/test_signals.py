import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosstide.operators import features as ft
from crosstide.operators.ranking import action_label, regime, with_cross_section
from crosstide.plans import signals as sg
from tests.conftest import last


def score(df, ticker="C"):
    rows = [r for r in df.collect() if r["ticker"] == ticker]
    return max(rows, key=lambda r: r["date"])["score"] if rows else None


def test_outperforming_child_is_positive(bars_of, edges_of):
    b = bars_of(P=[100] * 22, C=range(90, 112))
    assert score(sg.rs(b, edges_of(("P", "C", 1.0)))) > 0


def test_underperforming_child_is_negative(bars_of, edges_of):
    b = bars_of(P=[100] * 22, C=range(111, 89, -1))
    assert score(sg.rs(b, edges_of(("P", "C", 1.0)))) < 0


def test_short_history_has_no_score(bars_of, edges_of):
    assert sg.rs(bars_of(P=[100] * 5, C=[100] * 5), edges_of(("P", "C", 1.0))).count() == 0


def test_score_is_linear_in_weight(bars_of, edges_of):
    flat = bars_of(P=[100] * 22, C=[100] + [110] * 21)
    assert score(sg.rs(flat, edges_of(("P", "C", 0.5)))) == pytest.approx(0.0, abs=1e-9)
    b = bars_of(P=[100] * 21, C=[100] * 20 + [120])
    full, half = (score(sg.rs(b, edges_of(("P", "C", w)))) for w in (1.0, 0.5))
    assert full == pytest.approx(0.2, abs=1e-12) and half == pytest.approx(full / 2, abs=1e-9)


def test_parent_counts_with_its_own_last_row(bars_of, edges_of):
    # the parent stops trading one day earlier: its return is taken as of its last row
    b = bars_of(P=[100] * 20 + [110], C=[100] * 21 + [130])
    rows = {r["date"]: r for r in sg.rs(b, edges_of(("P", "C", 1.0))).collect()}
    assert rows[dt.date(2024, 1, 23)]["score"] == pytest.approx(0.3 - 0.1)


def test_missing_weight_counts_as_one(spark, bars_of):
    e = spark.createDataFrame([("P", "C", None)], "parent string, child string, weight double")
    assert score(sg.rs(bars_of(P=[100] * 21, C=[100] * 20 + [120]), e)) == pytest.approx(0.2)


@pytest.mark.parametrize(
    "value, label", [(95, "STRONG_BUY"), (65, "BUY"), (50, "HOLD"), (20, "HOLD"), (5, "SELL")]
)
def test_percentile_labels(spark, value, label):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("s"))
    row = with_cross_section(df, ["k"], "s").withColumn("a", action_label(F.col("pct_below"))).filter(F.col("s") == value).first()
    assert row["a"] == label


def test_labels_of_ten_single_and_missing(spark):
    df = spark.range(1, 11).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("s"))
    out = {r["s"]: r["a"] for r in with_cross_section(df, ["k"], "s").withColumn("a", action_label(F.col("pct_below"))).collect()}
    assert (out[10], out[9], out[7], out[1]) == ("STRONG_BUY", "STRONG_BUY", "BUY", "SELL")
    one = spark.createDataFrame([(1, 5.0), (1, None)], "k int, s double")
    got = {r["s"]: r["a"] for r in with_cross_section(one, ["k"], "s").withColumn("a", action_label(F.col("pct_below"))).collect()}
    assert got == {5.0: "SELL", None: "HOLD"}


def test_competition_rank_ties_and_missing(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 3.0, 5.0, None)], "k int, s double")
    for pooled in (False, True):
        rows = with_cross_section(df, ["k"], "s", pooled=pooled).collect()
        assert {(r["s"], r["rank_desc"]) for r in rows if r["s"]} == {(1.0, 5), (2.0, 4), (3.0, 2), (5.0, 1)}
        assert {r["n_valid"] for r in rows if r["s"]} == {5}


@pytest.mark.parametrize(
    "r, label", [(0.01, "UP"), (0.0, "MILD_PULLBACK"), (-0.05, "MILD_PULLBACK"), (-0.051, "CORRECTION"), (-0.15, "CORRECTION"), (-0.151, "DRAWDOWN"), (None, "UNKNOWN")]
)
def test_regimes(spark, r, label):
    assert spark.createDataFrame([(r,)], "r double").select(regime(F.col("r")).alias("x")).first()["x"] == label


def test_relative_volume_modes(bars_of):
    b = bars_of(A=[(10, 100)] * 20 + [(10, 300), (10, 200)], B=[(10, 100), (10, 50)], N=[(10, 100)] * 10 + [(10, None)] + [(10, 100)] * 10)
    out = {}
    for mode in ("strict", "lenient", "megacap", "backtest"):
        df = b.select("ticker", "date", ft.rvol(20, mode).alias("v"))
        out[mode] = {t: last(df, "v", t) for t in "ABN"}
    assert out["strict"] == {"A": pytest.approx(200 / 110), "B": None, "N": None}
    assert out["lenient"]["B"] == pytest.approx(0.5) and out["lenient"]["N"] == pytest.approx(100 / 95)
    assert out["megacap"]["N"] is None and out["backtest"]["A"] == pytest.approx(200 / 110)


def test_moving_average_excludes_today(bars_of):
    b = bars_of(A=[100] * 50 + [101, 50], S=[100] * 50)
    rows = {(r["ticker"], r["date"]): r["a"] for r in b.select("ticker", "date", ft.above_ma(50).alias("a")).collect()}
    d = dt.date(2024, 1, 2)
    assert rows[("A", d + dt.timedelta(50))] is True and rows[("A", d + dt.timedelta(51))] is False
    assert not any(v for (t, _), v in rows.items() if t == "S")


def test_streak_stops_at_break_and_is_capped(bars_of):
    up = [100 + i for i in range(120)]
    b = bars_of(U=up, D=up[:60] + [1] + up[61:70])
    df = ft.with_streak(b, cap=51)
    assert last(df, "days_above", "U") == 51 and last(df, "days_above", "D") == 9
    free = ft.with_streak(b)
    assert last(free, "days_above", "U") == 70 and last(free, "days_above", "D") == 9


def test_range_position_and_flat_range(bars_of):
    b = bars_of(A=list(range(1, 20)) + [10], F=[5] * 20, S=[1, 2])
    df = b.select("ticker", "date", ft.range_pct(20).alias("p"))
    assert last(df, "p", "A") == pytest.approx(50.0) and last(df, "p", "F") is None and last(df, "p", "S") is None


def test_forward_return_conventions(bars_of):
    df = bars_of(A=[100, 110, 121, 0, 5]).select(
        "ticker", "date", ft.forward_return(1).alias("n1"), ft.forward_return(2).alias("n2"), ft.forward_return(1, "signal_close").alias("s1")
    )
    rows = sorted(df.collect(), key=lambda r: r["date"])
    assert rows[0]["n1"] == 0.0 and rows[0]["n2"] == pytest.approx(0.1) and rows[0]["s1"] == pytest.approx(0.1)
    assert rows[2]["n1"] is None  # zero entry
    assert rows[4]["s1"] is None


def test_beta_of_a_doubled_market(bars_of):
    import random

    random.seed(1)
    m, a = [100.0], [100.0]
    for _ in range(70):
        r = random.uniform(-0.02, 0.02)
        m.append(m[-1] * (1 + r))
        a.append(a[-1] * (1 + 2 * r))
    b, market = bars_of(A=a), bars_of(M=m)
    for align in ("position", "date"):
        assert last(ft.with_beta(b.select("ticker", "date", "adj_close"), market, 60, align), "beta", "A") == pytest.approx(2.0, abs=1e-9)


def test_flat_market_has_no_beta(bars_of):
    b = bars_of(A=[100 + i % 3 for i in range(70)])
    assert last(ft.with_beta(b.select("ticker", "date", "adj_close"), bars_of(M=[100] * 70), 60), "beta", "A") is None


def test_history_percentile_counts_strictly_lower(bars_of):
    df = ft.with_hist_pct(bars_of(A=[100, 101, 102, 103, 104, 103]), 1, 3, "p")
    assert last(df, "p", "A") == 0.0
    up = ft.with_hist_pct(bars_of(A=[100, 101, 102, 103, 104, 110]), 1, 3, "p")
    assert last(up, "p", "A") == 1.0


def test_basket_needs_three_members_and_spread(spark, bars_of):
    b = bars_of(A=[100] * 20 + [110], B=[100] * 20 + [120], C=[100] * 20 + [130])
    basket = spark.createDataFrame([("t", x) for x in "ABC"], "theme string, ticker string")
    z = {r["ticker"]: r["z"] for r in sg.basket_zscore(b, basket).collect() if r["z"] is not None}
    assert z == {"A": pytest.approx(-1.224744871), "B": pytest.approx(0.0, abs=1e-12), "C": pytest.approx(1.224744871)}
    two = sg.basket_zscore(b.filter("ticker <> 'C'"), basket)
    assert all(r["z"] is None for r in two.collect())


@pytest.mark.parametrize(
    "t, m, b, theme, want",
    [
        (0.021, 0.0, 0.0, False, "STRONG"),
        (0.04, 0.0, 0.0, False, "STRONG"),
        (0.03, 0.005, -0.01, False, "BENCHMARK"),
        (0.021, 0.005, 0.0, False, None),
        (0.045, 0.0101, 0.02, False, "STRONG"),
        (0.045, 0.02, 0.02, False, None),
        (0.06, 0.0, 0.02, True, "SECTOR_OUTPERFORM"),
        (0.06, 0.0, 0.02, False, "STRONG"),
        (0.06, 0.001, 0.0, True, None),
    ],
)
def test_divergence_ladder(spark, t, m, b, theme, want):
    df = spark.createDataFrame([(t, m, b, theme)], "t double, m double, b double, f boolean")
    got = df.select(sg.divergence_strength(F.col("t"), F.col("m"), F.col("b"), F.col("f")).alias("s")).first()["s"]
    assert got == want


def test_confirmation_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(0.1, 1.5, None, True, True), (None, None, 0.2, None, False)], "rs double, v double, e double, i boolean, u boolean")
    c = F.col
    live = [r[0] for r in df.select(sg.confirm_live(c("rs"), c("v"), c("e"), c("i"), c("u"))).collect()]
    back = [r[0] for r in df.select(sg.confirm_backtest(c("rs") > 0, c("v"), c("i"), c("u"))).collect()]
    assert live == [4, 1] and back == [4, 0]


def test_graph_lookups(spark, edges_of):
    from crosstide.operators import graph as gr

    e = edges_of(("N", "V", 0.8), ("N", "A", 0.5), ("M", "V", 0.8), ("M", "A", 0.9))
    assert {r["child"] for r in gr.dependents(e, "N").collect()} == {"V", "A"}
    assert {r["parent"] for r in gr.parents(e, "V").collect()} == {"N", "M"}
    assert gr.edge_weight(e, "N", "V").first()["weight"] == 0.8
    assert gr.dependents(e, "ZZ").count() == 0 and gr.edge_weight(e, "N", "ZZ").count() == 0
    assert {(r["child"], r["parent"]) for r in gr.best_parent(e).collect()} == {("V", "N"), ("A", "M")}
    assert {r["ticker"] for r in gr.universe(e).collect()} == {"N", "M", "V", "A"}


def test_event_flags(spark):
    from crosstide.plans.scan import event_proximity

    rows = [(str(k), dt.date(2025, 1, 1) + dt.timedelta(k)) for k in (-1, 0, 2, 7, 14, 15)] + [("none", None)]
    df = event_proximity(spark.createDataFrame(rows, "ticker string, next_event_date date"), "2025-01-01")
    got = {r["ticker"]: (r["days"], r["flag"], r["severity"]) for r in df.collect()}
    assert got == {
        "-1": (None, "", ""),
        "0": (0, "EARNINGS TODAY", "red"),
        "2": (2, "EARNINGS TOMORROW", "red"),
        "7": (7, "EARNINGS 7d", "orange"),
        "14": (14, "EARNINGS 14d", "yellow"),
        "15": (15, "", ""),
        "none": (None, "", ""),
    }
