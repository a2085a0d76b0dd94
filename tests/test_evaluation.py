import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crosstide.operators import ic as icm
from crosstide.operators.asof import active_totals, asof_forward, asof_grid, asof_join
from crosstide.operators.ranking import average_rank, ordinal_rank, running_total
from crosstide.plans import backtests as bt

DAY = dt.date(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(i)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, most of them tied."""
    random.seed(3)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{i % 7}"
        rows.append((key, float(random.choice([0, 0, 0, 1, 2])) if i % 2 else random.random(), day(i % 40), f"t{i}"))
    return rows, spark.createDataFrame(rows, "k string, score double, date date, ticker string")


def test_pooled_ranks_match_brute_force_under_skew(spark, skewed):
    rows, df = skewed
    want_ord, want_avg = {}, {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3]))
        for i, r in enumerate(group):
            want_ord[r[3]] = i + 1
        for r in group:
            same = [i + 1 for i, q in enumerate(group) if q[1] == r[1]]
            want_avg[r[3]] = sum(same) / len(same)
    for pooled in (True, False):
        got = {r["ticker"]: r["x"] for r in ordinal_rank(df, ["k"], "score", ["date", "ticker"], "x", pooled).collect()}
        assert got == want_ord
        got = {r["ticker"]: r["x"] for r in average_rank(df, ["k"], "score", "x", pooled).collect()}
        assert got == want_avg


def test_running_total_without_keys(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    got = {r["v"]: r["rank"] for r in running_total(df, [], ["v"]).collect()}
    assert got == {v: v + 1 for v in range(500)}


def spearman_of(spark, pairs, **kw):
    rows = [("k", float(s), float(f), day(i), f"t{i:03d}") for i, (s, f) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k string, score double, fwd double, date date, ticker string")
    return icm.spearman(df, ["k"], **kw).first()


def test_two_rank_variants_differ_on_ties(spark):
    pairs = [(1, 1), (1, 2), (2, 3), (2, 5), (3, 4)]
    ordinal = spearman_of(spark, pairs, rank="ordinal", min_n=3)["ic"]
    average = spearman_of(spark, pairs, rank="average", min_n=5)["ic"]
    assert ordinal == pytest.approx(0.9)
    # ranks 1.5 1.5 3.5 3.5 5 against 1 2 3 5 4: covariance 7.5, variances 9 and 10
    assert average == pytest.approx(7.5 / 90**0.5)


def test_pooled_ic_derives_its_pairs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("k", float(i % 7), float(i * 5 % 11), day(i), f"t{i}") for i in range(40)] + [("k", None, 1.0, day(50), "t50")]
    obs = spark.createDataFrame(rows, "k string, score double, fwd double, date date, ticker string")
    got = icm.spearman(obs.mapInArrow(counted, obs.schema), ["k"], pooled=True).collect()
    assert read.value == len(rows)
    want = icm.spearman(obs, ["k"]).collect()
    assert [(r["k"], r["n"]) for r in got] == [("k", 40)] and got[0]["ic"] == pytest.approx(want[0]["ic"])


def test_small_or_constant_groups_have_no_ic(spark):
    assert spearman_of(spark, [(1, 1), (2, 2)], rank="ordinal", min_n=3)["ic"] is None
    assert spearman_of(spark, [(1, i) for i in range(6)], rank="average", min_n=5)["ic"] is None


def test_summary_skips_missing_dates(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (None,)], "ic double")
    row = icm.ic_summary(df, [], ddof=1).first()
    assert (row["n_dates"], row["ic_mean"]) == (2, pytest.approx(0.2))
    assert row["ic_std"] == pytest.approx(0.1414213562) and row["ic_ir"] == pytest.approx(0.2 / 0.1414213562)
    assert icm.ic_summary(df, [], ddof=0).first()["ic_std"] == pytest.approx(0.1)


def test_halves_by_date_and_by_row(spark):
    rows = [("a", day(i)) for i in (0, 0, 0, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "ticker string, date date")
    by_date = [r["half"] for r in icm.with_date_half(df).orderBy("date").collect()]
    assert by_date == ["H1"] * 4 + ["H2"] * 3
    by_row = [r["half"] for r in icm.with_row_half(df, ["ticker"]).orderBy("date").collect()]
    assert by_row.count("H1") == 3


def test_asof_join_takes_latest_not_later(spark):
    facts = spark.createDataFrame([("a", day(1), 10), ("a", day(3), 30), ("b", day(2), 99)], "t string, date date, v int")
    probe = spark.createDataFrame([("a", day(0), 1), ("a", day(2), 2), ("a", day(2), 3), ("a", day(3), 4), ("c", day(5), 5)], "t string, date date, id int")
    got = {r["id"]: (r["v"], r["fd"]) for r in asof_join(probe, facts, ["t"], "date", ["v"], fact_date="fd").collect()}
    assert got == {1: (None, None), 2: (10, day(1)), 3: (10, day(1)), 4: (30, day(3)), 5: (None, None)}


def test_asof_matches_brute_force_with_a_hot_key(spark):
    random.seed(5)
    facts = [("hot" if i % 3 else f"k{i}", day(i), i) for i in range(0, 60, 2)]
    probe = [("hot" if i % 3 else f"k{i % 10}", day(random.randrange(70)), i) for i in range(200)]
    f = spark.createDataFrame(facts, "t string, date date, v int")
    p = spark.createDataFrame(probe, "t string, date date, id int")
    got = {r["id"]: r["v"] for r in asof_join(p, f, ["t"], "date", ["v"]).collect()}
    for t, d, i in probe:
        earlier = [(fd, v) for ft_, fd, v in facts if ft_ == t and fd <= d]
        assert got[i] == (max(earlier)[1] if earlier else None)


def test_forward_asof_steps(spark):
    facts = spark.createDataFrame([("a", day(i), float(i)) for i in (1, 2, 4, 7)], "t string, date date, v double")
    probe = spark.createDataFrame([("a", day(i)) for i in (0, 1, 3, 4, 7)], "t string, date date")
    after = {r["date"]: (r["fwd_1"], r["fwd_2"]) for r in asof_forward(probe, facts, ["t"], "date", "v", (1, 2)).collect()}
    assert after == {day(0): (1.0, 2.0), day(1): (2.0, 4.0), day(3): (4.0, 7.0), day(4): (7.0, None), day(7): (None, None)}
    same = {r["date"]: (r["fwd_0"], r["fwd_1"]) for r in asof_forward(probe, facts, ["t"], "date", "v", (0, 1), include_same=True).collect()}
    assert same == {day(0): (1.0, 2.0), day(1): (1.0, 2.0), day(3): (4.0, 7.0), day(4): (4.0, 7.0), day(7): (7.0, None)}


def test_active_totals_are_inclusive_and_overlap(spark):
    rows = [("a", day(0), day(2), 5), ("a", day(2), day(3), 7), ("a", day(6), day(6), 1), ("b", day(5), day(4), 9)]
    df = spark.createDataFrame(rows, "t string, s date, e date, v int")
    got = {(r["t"], r["date"]): r["v"] for r in active_totals(df, ["t"], "s", "e", ["v"]).collect()}
    assert got == {("a", day(0)): 5, ("a", day(1)): 5, ("a", day(2)): 12, ("a", day(3)): 7, ("a", day(6)): 1}


def test_every_nth_date_drops_last(spark):
    from crosstide.plans.signals import every_nth_date

    bars = spark.createDataFrame([("a", day(i)) for i in range(23)], "ticker string, date date")
    got = [r["date"] for r in every_nth_date(bars, 5, 3, drop_last=True).orderBy("date").collect()]
    assert got == [day(3), day(8), day(13)]


def test_drawdown_and_sharpe(spark):
    rets = [0.1, -0.5, 0.2]
    df = spark.createDataFrame([(day(i), r) for i, r in enumerate(rets)], "date date, period_return double")
    row = bt.performance(df, 5).first()
    mean = sum(rets) / 3
    sd = (sum((r - mean) ** 2 for r in rets) / 3) ** 0.5
    assert row["max_drawdown"] == pytest.approx(-0.5) and row["sharpe"] == pytest.approx(mean / sd * (252 / 5) ** 0.5)
    flat = spark.createDataFrame([(day(i), 0.0) for i in range(3)], "date date, period_return double")
    assert bt.performance(flat, 5).first()["sharpe"] == 0.0


def test_empty_basket_counts_as_zero(spark):
    obs = spark.createDataFrame([("a", "P", day(0), 1.0, None), ("b", "P", day(1), 1.0, 0.3), ("b", "Q", day(1), 2.0, 0.3)], "ticker string, parent string, date date, score double, fwd double")
    dates = spark.createDataFrame([(day(i),) for i in range(3)], "date date")
    got = {r["date"]: r["period_return"] for r in bt.period_returns(obs, dates).collect()}
    assert got == {day(0): 0.0, day(1): pytest.approx(0.3), day(2): 0.0}


def test_walk_forward_against_plain_python(spark, bars_of, edges_of):
    random.seed(11)
    px = {}
    for t in "PQABCDEFG":
        level, out = 100.0, []
        for i in range(60):
            level *= 1 + random.uniform(-0.03, 0.03)
            out.append(None if t in "AE" and random.random() < 0.2 else level)
        px[t] = out
    b = bars_of(**px)
    pairs = [("P", c, 0.5 + i / 10) for i, c in enumerate("ABCD")] + [("Q", c, 1.0) for c in "DEFG"]
    obs = bt.walk_forward_obs(b, edges_of(*pairs), horizon=5)
    got = {(r["ticker"], r["parent"], r["date"]): r for r in obs.collect()}

    start = dt.date(2024, 1, 2)
    series = {t: [(start + dt.timedelta(i), v) for i, v in enumerate(vs) if v is not None] for t, vs in px.items()}

    def back(t, d, n):
        past = [v for x, v in series[t] if x <= d]
        return (past[-1] - past[-1 - n]) / past[-1 - n] if len(past) > n else None

    dates = [start + dt.timedelta(i) for i in range(60)][20::5][:-1]
    seen = 0
    for d in dates:
        scores = {}
        for p, c, w in pairs:
            rc, rp = back(c, d, 20), back(p, d, 20)
            if rc is not None and rp is not None:
                scores[(c, p)] = (rc - rp) * w
        for (c, p), s in scores.items():
            row = got[(c, p, d)]
            seen += 1
            assert row["score"] == pytest.approx(s, abs=1e-12)
            after = [v for x, v in series[c] if x > d]
            want = (after[4] - after[0]) / after[0] if len(after) >= 5 else None
            assert row["fwd"] == (pytest.approx(want, abs=1e-12) if want is not None else None)
            onward = [v for x, v in series[c] if x >= d]
            want = (onward[1] - onward[0]) / onward[0] if len(onward) > 1 else None
            assert row["diag_1"] == (pytest.approx(want, abs=1e-12) if want is not None else None)
            pct = sum(v < s for v in scores.values()) / len(scores)
            want = "STRONG_BUY" if pct >= 0.8 else "BUY" if pct >= 0.6 else "HOLD" if pct >= 0.2 else "SELL"
            assert row["action"] == want
    assert seen == len(got) > 0


def test_verdicts(spark):
    rows = [(0.06, 0.1, 0.1, 200), (0.06, -0.1, 0.1, 200), (0.03, 0.1, 0.1, 200), (None, 0.1, 0.1, 200), (0.06, 0.1, 0.1, 10)]
    df = spark.createDataFrame(rows, "ic double, a double, b double, n int")
    c = F.col
    got = [tuple(r) for r in df.select(bt.pass_verdict(c("ic"), c("a"), c("b"), c("n")), bt.three_way_verdict(c("ic"), c("a"), c("b")), bt.sufficiency(c("n"))).collect()]
    assert got == [("PASS", "PASS", "OK"), ("FAIL", "FAIL", "OK"), ("FAIL", "MARGINAL", "OK"), ("N/A", "FAIL", "OK"), ("INSUF", "PASS", "INSUFFICIENT")]


def test_unknown_signal_is_rejected(bars_of, edges_of):
    with pytest.raises(ValueError):
        bt.walk_forward_obs(bars_of(A=[1, 2]), edges_of(("A", "B", 1.0)), signal="nope")


def test_short_history_and_unknown_parents_are_errors(bars_of, edges_of):
    with pytest.raises(ValueError, match="34 trading dates, 35"):
        bt.walk_forward_obs(bars_of(A=[1.0] * 34, B=[1.0] * 20), edges_of(("A", "B", 1.0)))
    with pytest.raises(ValueError, match=r"unknown parents: \['C'\]"):
        bt.walk_forward_obs(bars_of(A=[1.0] * 60), edges_of(("A", "B", 1.0)), parents=["C", "A"])


def test_grid_takes_the_latest_fact_on_every_date_asked_for(spark):
    random.seed(8)
    facts = sorted({("hot" if i % 3 else f"k{i % 4}", day(random.randrange(50))) for i in range(60)})
    asked = [day(i) for i in (0, 3, 7, 8, 30, 49, 60)]
    f = spark.createDataFrame([(t, d, i) for i, (t, d) in enumerate(facts)], "t string, date date, v int")
    dates = spark.createDataFrame([(d,) for d in asked], "date date")
    got = {(r["t"], r["date"]): (r["v"], r["fd"]) for r in asof_grid(f, dates, ["t"], "date", ["v"], fact_date="fd").collect()}
    want = {}
    for key in {t for t, _ in facts}:
        for d in asked:
            earlier = [(fd, i) for i, (t, fd) in enumerate(facts) if t == key and fd <= d]
            if earlier:
                want[(key, d)] = (max(earlier)[1], max(earlier)[0])
    assert got == want
    assert asof_grid(f, dates.limit(0), ["t"], "date", ["v"]).count() == 0


def test_registered_signals_of_any_form_meet_the_states(spark, bars_of, edges_of):
    from crosstide.plans import signals as sg

    random.seed(2)
    b = bars_of(P=[100 + random.random() for _ in range(60)], A=[50 + random.random() for _ in range(60)], B=[9 + random.random() for _ in range(60)])
    e = edges_of(("P", "A", 1.0), ("P", "B", 2.0))
    sg.register_signal("same", lambda bars, edges, lookback, dates: sg.rs(bars, edges, lookback, dates))
    try:
        rows = lambda name: sorted(tuple(r) for r in bt.walk_forward_obs(b, e, name, 5).collect())
        assert rows("same") == rows("rs") != []
    finally:
        sg.SIGNALS.pop("same")


def test_split_dates_needs_four(spark):
    rows = lambda n: spark.createDataFrame([(day(i % n),) for i in range(12)], "date date")
    assert tuple(bt.split_dates(rows(3)).first()) == (3, None, None, None)
    assert tuple(bt.split_dates(rows(5)).first()) == (5, day(0), day(2), day(4))
