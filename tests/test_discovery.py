import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosstide.plans import discovery as dc

DOC = "ticker string, accession_number string, business string, risk_factors string"
NO_CACHE = "ticker string, accession_number string, placeholder string, resolved_parent string, confidence double, resolved_by string"


def hits(spark, business, risk=""):
    df = dc.extract_hits(spark.createDataFrame([("T", "1", business, risk)], DOC))
    return [(r["pass"], r["name"], r["pct"]) for r in df.orderBy("pass", "position").collect()]


@pytest.mark.parametrize(
    "text, name",
    [
        ("NVIDIA accounted for 67% of revenue", "NVIDIA"),
        ("67% of revenue was from NVIDIA.", "NVIDIA"),
        ("NVIDIA represented 67% of net revenue", "NVIDIA"),
        ("NVIDIA was responsible for 67% of revenue", "NVIDIA"),
        ("Our revenue concentration of 67% from NVIDIA, is high", "NVIDIA"),
        ("NVIDIA\n Corporation accounted  for approximately 67 % of our total net revenue", "Corporation"),
    ],
)
def test_sentence_patterns(spark, text, name):
    assert hits(spark, "Intro. " + text) == [(2, name, 67.0)]


def test_table_row_comes_first_and_small_shares_are_dropped(spark):
    text = "Apple represented 12.5% of net revenue.\n| Customer A | 20 % | x |\n|  Tiny Co | 9.9% |\nBig Corp accounted for 9% of revenue."
    assert hits(spark, text) == [(1, "Customer A", 20.0), (2, "Apple", 12.5)]


def test_only_first_pattern_of_a_sentence(spark):
    text = "Apple accounted for 30% of revenue and 20% of revenue was from Tesla, too"
    assert hits(spark, text) == [(2, "Apple", 30.0)]


@pytest.mark.parametrize(
    "name, parent",
    [("NVIDIA Corporation", "NVDA"), ("sales to Amazon Web Services", "AMZN"), ("Tesla Motors Netherlands", "TSLA"), ("Acme", None), ("Azure Metals", "MSFT"), ("soft", "MSFT")],
)
def test_alias_containment_in_both_directions(spark, name, parent):
    assert spark.createDataFrame([(name,)], "n string").select(dc.match_alias(F.col("n")).alias("p")).first()["p"] == parent


@pytest.mark.parametrize(
    "name, want",
    [("Customer A", True), ("customer 12", True), ("one customer", True), ("a single customer", True), ("our largest customer", True), ("one major customer", True), ("Customer AB", False), ("the customer", False), ("Acme", False)],
)
def test_placeholders(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(dc.is_placeholder(F.col("n")).alias("p")).first()["p"] is want


def resolve(spark, text, cache=()):
    docs = spark.createDataFrame([("T", "1", text, "")], DOC)
    out = dc.concentrations(docs, spark.createDataFrame(list(cache), NO_CACHE))
    return [(r["parent"], r["pct"], r["resolved_by"]) for r in out.collect()]


def test_placeholder_by_context(spark):
    base = "We ship parts. Customer A accounted for 40% of revenue. {} Fine. Good. CUDA again."
    assert resolve(spark, base.format("It runs CUDA on every GPU.")) == [("NVDA", 40.0, "regex")]
    assert resolve(spark, base.format("It runs well.")) == []
    # the last sentence is outside the window of three sentences after the mention
    assert resolve(spark, "Customer A accounted for 40% of revenue. One GPU. B. C. D. CUDA again.") == []


def test_cached_resolution_wins(spark):
    text = "Customer A accounted for 40% of revenue. It runs CUDA on every GPU."
    assert resolve(spark, text, [("T", "1", "Customer A", "AAPL", 0.9, "model")]) == [("AAPL", 40.0, "model")]
    assert resolve(spark, text, [("T", "1", "Customer A", None, 0.0, "low_conf")]) == []
    assert resolve(spark, text, [("T", "1", "Customer A", None, 0.0, "unresolved")]) == [("NVDA", 40.0, "regex")]


def test_second_run_resolves_from_the_stored_rows(spark):
    text = "Customer A accounted for 40% of revenue. It runs CUDA on every GPU."
    dull = "Customer B accounted for 30% of revenue. It runs well."
    docs = spark.createDataFrame([("T", "1", text, ""), ("U", "2", dull, "")], "ticker string, accession_number string, business string, risk_factors string")
    hits = dc.extract_hits(docs)
    old = [("T", "1", "Customer A", None, 0.0, "unresolved"), ("U", "2", "Customer B", None, 0.0, "unresolved"), ("V", "3", "Customer C", "AAPL", 0.9, "model")]
    cache = spark.createDataFrame(old, NO_CACHE)
    stored = dc.with_resolutions(cache, dc.resolve_placeholders(hits, cache))
    rows = sorted(tuple(r) for r in stored.select(*cache.columns).collect())
    assert rows == [("T", "1", "Customer A", "NVDA", 0.85, "regex"), *old[1:]]
    # no clue is left to find, so what is resolved comes from the stored rows
    again = dc.resolve_placeholders(hits, spark.createDataFrame(rows, NO_CACHE), {"NVDA": ["no such words"]})
    assert {r["name"]: (r["parent"], r["resolved_by"]) for r in again.collect()} == {"Customer A": ("NVDA", "regex"), "Customer B": (None, "unresolved")}


def test_first_hit_per_parent(spark):
    text = "Apple accounted for 30% of revenue. Apple Inc represented 50% of net revenue. | x |\n| Apple | 11 % |"
    assert resolve(spark, text) == [("AAPL", 11.0, "explicit")]


def test_liquidity_gate(spark):
    rows = []
    for t, close, vol in (("ok", 100.0, 1_000_000), ("cheap", 4.0, 10_000_000), ("thin", 100.0, 10)):
        rows += [(t, dt.date(2025, 1, 1) + dt.timedelta(i), close, vol) for i in range(300)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, volume bigint")
    day = "2025-10-27"
    recent = {r["ticker"]: r["reason"] for r in dc.liquidity_gate(bars, day).collect()}
    assert recent == {"ok": "listing age", "cheap": "price", "thin": "adv"}
    full = {r["ticker"]: r["reason"] for r in dc.liquidity_gate(bars, day, "history").collect()}
    assert full == {"ok": "", "cheap": "price", "thin": "adv"}


def candidates(spark):
    d = dt.date(2025, 1, 1)
    rows = [("A", "P", "STRONG", d, "ACCUMULATING"), ("B", "P", "MEDIUM", d, "READY_FOR_BACKTEST"), ("C", "P", "MEDIUM", d, "READY_FOR_BACKTEST"), ("F", "P", "MEDIUM", d, "FAILED")]
    return spark.createDataFrame(rows, "ticker string, parent string, dependency_strength string, discovered_date date, status string")


def test_life_cycle(spark):
    c = candidates(spark)
    rs = spark.createDataFrame([("A", "P", dt.date(2025, 1, 1) + dt.timedelta(i), float(i)) for i in range(60)], "ticker string, parent string, date date, rs_score double")
    assert {r["ticker"]: r["status"] for r in dc.advance_ready(c, rs).collect()}["A"] == "READY_FOR_BACKTEST"
    assert {r["ticker"]: r["status"] for r in dc.advance_ready(c, rs.limit(59)).collect()}["A"] == "ACCUMULATING"
    ics = spark.createDataFrame([("B", "P", 0.1, 0.1, 0.1, True)], "ticker string, parent string, ic_h1 double, ic_h2 double, ic_full double, passed boolean")
    after = dc.decide(c, ics)
    assert {r["ticker"]: r["status"] for r in after.collect()} == {"A": "ACCUMULATING", "B": "PROMOTED", "C": "FAILED", "F": "FAILED"}
    assert [(r["child"], r["weight"]) for r in dc.promoted_edges(c, after).collect()] == [("B", 0.3)]
    none = spark.createDataFrame([], "ticker string, parent string, run_date date, ic_h1 double, ic_h2 double, ic_full double, passed boolean")
    assert {(r["ticker"], r["passed"]) for r in dc.backtest_results(c, ics, none, "2025-02-01").collect()} == {("B", True), ("C", False)}


def test_exclusions(spark):
    h = spark.createDataFrame([(t, p) for t, p in (("A", "NVDA"), ("F", "NVDA"), ("G", "NVDA"), ("N", "NVDA"), ("N", "XX"))], "ticker string, parent string")
    graph = spark.createDataFrame([("G",)], "ticker string")
    near = {(r["ticker"], r["parent"]): r["reason"] for r in dc.exclusions(h, graph, candidates(spark), "2025-02-01").collect()}
    assert near == {("A", "NVDA"): "already in discovery", ("F", "NVDA"): "failed recently", ("G", "NVDA"): "already active", ("N", "NVDA"): "", ("N", "XX"): "unknown parent"}
    late = {r["ticker"]: r["reason"] for r in dc.exclusions(h, graph, candidates(spark), "2025-08-01").collect() if r["parent"] == "NVDA"}
    assert late["F"] == ""


def test_trend_excludes_by_value(spark):
    values = [9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 1.0, 1.0, 1.0, 1.0]  # newest last
    rows = [("A", "P", dt.date(2025, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ticker string, parent string, date date, rs_score double")
    r = dc.accum_trend(df).first()
    # newest five are 1 1 1 1 9, so every 9 is excluded from the earlier ones
    assert r["last5"] == pytest.approx(2.6) and r["prior5"] is None and r["trend"] == "→"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_ends_and_positions(spark):
    ends = ["\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    df = dc.extract_hits(spark.createDataFrame([("T", "1", "".join(f"|  Name {i} | {i + 10}% |{e}" for i, e in enumerate(ends)), "")], DOC))
    rows = [(r["position"], r["name"], r["pct"]) for r in df.filter("pass = 1").orderBy("position").collect()]
    assert rows == [(i, f"Name {i}", i + 10.0) for i in range(len(ends))]


def test_name_patterns_first_look_for_their_words(spark):
    plan = optimized(dc.extract_hits(spark.createDataFrame([("T", "1", "x", "")], DOC)))
    for word in ("accounted", "represented", "was"):
        # names and shares are read where the words after a name are
        assert plan.count(f", (?iU){word}\\s+") == plan.count(f"(.{{3,60}}?)\\s+{word}\\s+") == 2, plan
    text = "x" * 200 + " 5% ACCOUNTED for 3 parts. In 9 accounted for 8% of it, Apple  Inc Accounted for 30% of Revenue. accounted for 20% of revenue."
    assert hits(spark, text) == [(2, "In 9 accounted for 8% of it, Apple Inc", 30.0)]


def test_a_filter_on_names_does_not_repeat_their_cleaning(spark):
    h = dc.extract_hits(spark.createDataFrame([("T", "1", "x", "")], DOC))
    plan = optimized(h.filter(dc.match_alias(F.col("name")).isNull() & dc.is_placeholder(F.col("name"))))
    assert plan.count("regexp_replace") == 2, plan


def test_names_are_grouped_before_they_are_matched(spark):
    from crosstide.catalog import ENTRIES

    plan = ENTRIES["matched_names"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keys = next(line for line in plan.splitlines() if "Aggregate [" in line)
    assert "nvidia" not in keys.split("], [")[0], keys


def test_names_are_bound_once_and_split_texts_only_for_placeholders(spark):
    h = dc.extract_hits(spark.createDataFrame([("T", "1", "x", "")], DOC))
    plan = optimized(h.select(dc.match_alias(F.col("name")).alias("p")))
    assert plan.count("lower(") == 1, plan
    matched = h.withColumn("parent", dc.match_alias(F.col("name")))
    plan = optimized(dc.resolve_placeholders(matched, spark.createDataFrame([], NO_CACHE)).select("parent", "resolved_by"))
    split = [line for line in plan.splitlines() if "split(text" in line or "split(_all" in line]
    assert split and all("CASE WHEN isnull(parent" in line for line in split), plan


def test_stored_rows_and_inserts_read_the_texts_once(spark):
    from crosstide.catalog import ENTRIES

    for name in ("stored_resolutions", "inserted_candidates"):
        plan = optimized(ENTRIES[name].run(spark, "/root/testdata/sf0.001"))
        assert plan.count("accounted") == 0, (name, plan)  # kept before, read from there
