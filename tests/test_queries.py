"""Registered queries against their SQL, and the stream against the batch operator."""

import datetime as dt
import os
import random
import tempfile

import pytest

from crosstide.catalog import ENTRIES

SF = "/root/testdata/sf0.001"
CORE = [
    "derived_bars",
    "relative_volume",
    "relative_strength",
    "scored_edges",
    "basket_zscore",
    "daily_ic_ordinal",
    "insider_summary",
    "insider_scores",
    "insider_daily_summary",
    "upsert_bars",
    "upserted_store",
    "accumulated_in_batches",
    "filing_impacts",
    "form4_trades",
    "concentrations",
    "liquidity_gate",
    "walk_forward_observations",
    "walk_forward_performance",
    "walk_forward_split",
    "segment_information_coefficients",
]
PLANNED = ["dependent_scan", "captured_journal", "theme_scan", "scored_edges", "insider_daily_summary"]
NAMES = sorted(ENTRIES) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    from check import duck

    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    from check import compare

    e = ENTRIES[name]
    ok, msg = compare(spark, con, name, e.run, e.sql, SF)
    assert ok, msg


def test_no_registered_plan_multiplies_rows(spark):
    from crosstide.operators.ranking import with_cross_section

    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "ticker string, s double").repartition(2)
    ranked = with_cross_section(rows, [], "s", pooled=True)
    bad = {}
    for name, df in [("pooled", ranked), *[(n, ENTRIES[n].run(spark, SF)) for n in PLANNED]]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            bad[name] = plan
    assert bad == {}
    assert {r["ticker"]: r["pct_below"] for r in ranked.collect()} == {"a": 0.0, "b": 0.5}


@pytest.mark.parametrize("name", ["walk_forward_observations", "walk_forward_performance", "segment_information_coefficients"])
def test_walk_forward_plans_scan_few_tables(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    plan = ENTRIES[name].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 10, plan


@pytest.mark.parametrize("name", ["aligned_members", "composite_backtest_daily", "composite_backtest_ingredients"])
def test_plans_on_aligned_members_scan_no_table_again(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    plan = ENTRIES[name].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 0, plan


def test_step_reads_a_tail_and_late_bars_reopen_their_dates(spark):
    from crosstide.plans.signals import accumulate_rs
    from crosstide.streaming import accumulate as ac

    rnd = random.Random(7)
    rows = []
    for t in ("A", "B", "P", "M"):
        level = 100.0
        for i in range(150):
            level *= 1 + rnd.uniform(-0.02, 0.02)
            if not (t == "B" and i < 100):
                rows.append((t, dt.date(2024, 1, 1) + dt.timedelta(i), level))
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    late = [("P", day(40)), ("A", day(95))]
    batches = [
        [r for r in rows if r[1] < day(90) and r[:2] not in late],
        [r for r in rows if day(90) <= r[1] < day(120) and r[:2] not in late],
        [r for r in rows if day(120) <= r[1] < day(130)],
        [r for r in rows if r[:2] in late or day(130) <= r[1]],
    ]
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    pairs = spark.createDataFrame([("A", "P"), ("B", "P")], "ticker string, parent string")
    frame = lambda x: spark.createDataFrame(x, ac.BARS_DDL)
    none = spark.createDataFrame([], "ticker string, parent string, date date")
    read, made = [], ac.known_bars

    def counted(*args):
        read.append(made(*args))
        return read[-1]

    ac.known_bars = counted
    try:
        for k, b in enumerate(batches):
            for _ in range(2 if k == 1 else 1):  # a replayed batch changes nothing
                ac.accumulate_batch(frame(b), k, pairs, "M", root + "/bars", root + "/rs", beta_window=30, slack=5)
    finally:
        ac.known_bars = made
    assert all(n.count() <= 4 * 36 + len(b) for n, b in zip(read[1:4], [batches[1], batches[1], batches[2]]))
    got = {(r["ticker"], r["date"]): (r["rs_score"], r["rs_adj"]) for r in spark.read.parquet(root + "/rs").collect()}
    every = frame(rows)
    want = accumulate_rs(every.filter("ticker <> 'M'"), pairs, every.filter("ticker = 'M'"), none, beta_window=30).collect()
    assert len(got) == len(want) > 100
    for r in want:
        a = got[r["ticker"], r["date"]]
        assert a[0] == pytest.approx(r["rs_score"], abs=1e-12)
        assert a[1] == (r["rs_adj"] if r["rs_adj"] is None else pytest.approx(r["rs_adj"], abs=1e-12))


def test_every_query_has_check_sql():
    assert [n for n, e in ENTRIES.items() if not e.sql] == []


def test_streamed_accumulation_equals_batch(spark):
    from crosstide.plans.signals import accumulate_rs
    from crosstide.streaming.accumulate import BARS_DDL, RS_DDL, start_accumulation

    random.seed(4)
    rows = []
    for t in ("A", "P", "M"):
        level = 100.0
        for i in range(80):
            level *= 1 + random.uniform(-0.02, 0.02)
            rows.append((t, dt.date(2024, 1, 1) + dt.timedelta(i), level))
    bars = spark.createDataFrame(rows, BARS_DDL)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cut = dt.date(2024, 3, 10)
    bars.filter(bars.date < cut).coalesce(1).write.parquet(root + "/in/first")
    pairs = spark.createDataFrame([("A", "P")], "ticker string, parent string")

    def run():
        stream = spark.readStream.schema(BARS_DDL).option("recursiveFileLookup", "true").parquet(root + "/in")
        start_accumulation(stream, pairs, "M", root + "/bars", root + "/rs", root + "/ckpt").awaitTermination()

    run()
    bars.filter(bars.date >= cut).coalesce(1).write.parquet(root + "/in/second")
    run()
    stored = spark.read.schema(RS_DDL + ", batch int").parquet(root + "/rs")
    got = {(r["date"], r["batch"] > 0): (r["rs_score"], r["rs_adj"]) for r in stored.collect()}
    none = spark.createDataFrame([], "ticker string, parent string, date date")
    want = {
        (r["date"], r["date"] >= cut): (r["rs_score"], r["rs_adj"])
        for r in accumulate_rs(bars.filter("ticker <> 'M'"), pairs, bars.filter("ticker = 'M'"), none).collect()
    }
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12) if v[1] is not None else got[k] == v
