"""Queries over candidate discovery and research comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog import inputs as inp
from crosstide.catalog import q_backtests as qb
from crosstide.catalog.q_backtests import halves_sql, half_sql, ic_sql
from crosstide.catalog.registry import query, r8
from crosstide.catalog.sqlparts import part, r8s, with_parts
from crosstide.plans import backtests as bt
from crosstide.plans import discovery as dc
from crosstide.plans import research as rs

# ---- texts --------------------------------------------------------------------------

NAMES = {
    "BUILDING": "NVIDIA Corporation",
    "MACHINERY": "Microsoft",
    "HOUSEHOLD": "Customer B",
    "FURNITURE": "our largest customer",
    "AUTOMOBILE": "Acme Holdings",
}
CLUES = {
    "F": "They use our GPU and CUDA stack.",
    "O": "They host on Azure.",
    "P": "They build the electric vehicle and its drivetrain.",
}


def _case(col: str, values: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_TEMPLATES = {
    "1-URGENT": "We sell parts. {n} accounted for approximately {p}% of our total revenue this year. {c} Other text.",
    "2-HIGH": "We sell parts. Some {p} % of net revenue was derived from {n}, in total. {c} More text.",
    "3-MEDIUM": "We sell parts!\u00a0{n}\u00a0 represented\u2003{p}% of net revenue. {c} More text.",
    "4-NOT SPECIFIED": "Customers:\n| Name | Share |\f | {n} | {p} % | yes |\n{c} More text.",
    "5-LOW": "We sell parts? {n} was responsible for {p}% of our revenue. {c} A revenue concentration of 55% from Tesla Inc, is high.",
}


def docs(spark, d):
    """One annual report per order: its customer segment, priority and status pick the wording."""
    t = inp.table(spark, d, "orders").join(inp.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        inp.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    t = inp.spread(t.select("o_orderkey", "o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name"), "o_orderkey")

    def pick(col, values):
        out = F.lit(None).cast("string")
        for k, v in values.items():
            out = F.when(F.col(col) == k, v).otherwise(out)
        return out

    text = pick("o_orderpriority", _TEMPLATES)
    pct = F.concat((F.col("o_orderkey") % 40).cast("string"), F.when(F.col("o_orderstatus") == "F", ".5").otherwise(""))
    for key, value in (("{n}", pick("c_mktsegment", NAMES)), ("{p}", pct), ("{c}", pick("o_orderstatus", CLUES))):
        text = F.replace(text, F.lit(key), value)
    return t.select(
        F.col("n_name").alias("ticker"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession_number"),
        text.alias("business"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise("Risks are many. Demand may fall.").alias("risk_factors"),
    )


part(
    "docs",
    f"""
SELECT n_name AS ticker, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession_number,
  replace(replace(replace({_case('o_orderpriority', {k: v.replace(chr(10), "' || chr(10) || '") for k, v in _TEMPLATES.items()})}, '{{n}}', {_case('c_mktsegment', NAMES)}),
   '{{p}}', CAST(o_orderkey % 40 AS VARCHAR) || CASE WHEN o_orderstatus = 'F' THEN '.5' ELSE '' END), '{{c}}', {_case('o_orderstatus', CLUES)}) AS business,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Risks are many. Demand may fall.' END AS risk_factors
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)


WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}]"
LINE_ENDS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _rx(p: str) -> str:
    # the engine that checks knows only ASCII white space as \\s
    return p.replace("'", "''").replace(r"\s", WHITE)


def _ex(col: str, p: str, k: int) -> str:
    return f"nullif(regexp_extract({col}, '{_rx(p)}', {k}, 'i'), '')"


_SPLIT = "string_split(regexp_replace({t}, '([.!?])" + WHITE + "+', '\\1' || chr(1), 'g'), chr(1))"
part(
    "hits",
    f"""
SELECT ticker, accession_number, pass, position, trim(regexp_replace(name, '{WHITE}+', ' ', 'g')) AS name, CAST(pct AS DOUBLE) AS pct FROM (
 SELECT ticker, accession_number, 1 AS pass, i - 1 AS position, {_ex('line', dc.TABLE_ROW_PATTERN, 1)} AS name, {_ex('line', dc.TABLE_ROW_PATTERN, 2)} AS pct
 FROM (SELECT *, unnest(string_split(regexp_replace(txt, '{LINE_ENDS}', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(txt, '{LINE_ENDS}', chr(10), 'g'), chr(10)), 1) AS i FROM (SELECT *, concat_ws(chr(10) || chr(10), business, nullif(risk_factors, '')) AS txt FROM docs))
 UNION ALL SELECT ticker, accession_number, 2, i - 1, coalesce({', '.join(_ex('s', p, n) for p, n, _ in dc.CONCENTRATION_PATTERNS)}), coalesce({', '.join(_ex('s', p, k) for p, _, k in dc.CONCENTRATION_PATTERNS)})
 FROM (SELECT *, unnest({_SPLIT.replace('{t}', 'txt')}) AS s, generate_subscripts({_SPLIT.replace('{t}', 'txt')}, 1) AS i FROM (SELECT *, concat_ws(chr(10) || chr(10), business, nullif(risk_factors, '')) AS txt FROM docs)))
WHERE name IS NOT NULL AND CAST(pct AS DOUBLE) >= 10""",
    "docs",
)


@query(
    "concentration_table_rows",
    "D-01",
    with_parts("SELECT ticker, accession_number, CAST(position AS BIGINT) AS position, name, pct FROM hits WHERE pass = 1", "hits"),
)
def _(spark, d):
    h = dc.extract_hits(docs(spark, d)).filter("pass = 1")
    return h.select("ticker", "accession_number", F.col("position").cast("long").alias("position"), "name", "pct")


@query(
    "concentration_sentences",
    "D-02",
    with_parts("SELECT ticker, accession_number, CAST(position AS BIGINT) AS position, name, pct FROM hits WHERE pass = 2", "hits"),
)
def _(spark, d):
    h = dc.extract_hits(docs(spark, d)).filter("pass = 2")
    return h.select("ticker", "accession_number", F.col("position").cast("long").alias("position"), "name", "pct")


def _alias_sql(col: str) -> str:
    low = f"lower(trim({col}))"
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({low}, '{a.lower()}') OR contains('{a.lower()}', {low})" for a in words) + f" THEN '{p}'"
        for p, words in dc.PARENT_ALIASES.items()
    ) + " END"


_HOLDER = " OR ".join(f"regexp_matches(trim(name), '{p}', 'i')" for p in dc.PLACEHOLDER_PATTERNS)


@query(
    "matched_names",
    "D-03 D-04",
    with_parts(f"SELECT name, {_alias_sql('name')} AS parent, {_HOLDER} AS placeholder, count(*) AS n FROM hits GROUP BY 1, 2, 3", "hits"),
)
def _(spark, d):
    names = dc.extract_hits(docs(spark, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return names.select("name", dc.match_alias(F.col("name")).alias("parent"), dc.is_placeholder(F.col("name")).alias("placeholder"), "n")


# stored resolutions: some filings of urgent orders were resolved before, some without result
part(
    "res_cache",
    """
SELECT n_name AS ticker, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession_number, 'Customer B' AS placeholder,
  CASE WHEN o_orderstatus = 'O' THEN 'AAPL' END AS resolved_parent, CASE o_orderstatus WHEN 'O' THEN 'model' WHEN 'F' THEN 'low_conf' ELSE 'unresolved' END AS resolved_by
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'""",
)


def res_cache(spark, d):
    t = inp.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    t = t.join(inp.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        inp.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    s = F.col("o_orderstatus")
    return t.select(
        F.col("n_name").alias("ticker"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession_number"),
        F.lit("Customer B").alias("placeholder"),
        F.when(s == "O", "AAPL").alias("resolved_parent"),
        F.when(s == "O", 0.9).alias("confidence"),
        F.when(s == "O", "model").when(s == "F", "low_conf").otherwise("unresolved").alias("resolved_by"),
    )


def _clue_counts() -> str:
    items = []
    for i, (p, words) in enumerate(dc.CONTEXT_CLUES.items()):
        hits = " + ".join(f"contains(win, '{w.lower()}')::INT" for w in words)
        items.append(f"{{'hits': {hits}, 'ord': {-i}, 'parent': '{p}'}}")
    return "list_max([" + ", ".join(items) + "])"


part(
    "resolved",
    f"""
SELECT ticker, accession_number, pass, position, name, pct, CASE WHEN by_cache IS NOT NULL THEN cached ELSE CASE WHEN best.hits >= 2 THEN best.parent END END AS parent,
  CASE WHEN by_cache IS NOT NULL THEN by_cache WHEN best.hits >= 2 THEN 'regex' ELSE 'unresolved' END AS resolved_by
FROM (SELECT *, {_clue_counts()} AS best FROM (
 SELECT *, CASE WHEN hit_at > 0 THEN lower(array_to_string(list_slice(ss, greatest(hit_at - 1, 1), least(len(ss), hit_at + 3)), ' ')) ELSE '' END AS win FROM (
 SELECT h.*, c.resolved_parent AS cached, c.resolved_by AS by_cache, ss, coalesce(list_position(list_transform(ss, lambda x: contains(lower(x), lower(h.name))), TRUE), 0) AS hit_at
 FROM hits h JOIN (SELECT ticker, accession_number, {_SPLIT.replace('{t}', '(business || chr(10) || chr(10) || risk_factors)')} AS ss FROM docs) d USING (ticker, accession_number)
 LEFT JOIN (SELECT * FROM res_cache WHERE resolved_by <> 'unresolved') c ON c.ticker = h.ticker AND c.accession_number = h.accession_number AND c.placeholder = h.name
 WHERE {_alias_sql('h.name')} IS NULL AND ({_HOLDER.replace('(name)', '(h.name)')}))))""",
    "hits",
    "docs",
    "res_cache",
)


@query(
    "resolved_placeholders",
    "D-05",
    with_parts("SELECT ticker, accession_number, name, pct, parent, resolved_by FROM resolved", "resolved"),
)
def _(spark, d):
    h = dc.extract_hits(docs(spark, d))
    hidden = h.filter(dc.match_alias(F.col("name")).isNull() & dc.is_placeholder(F.col("name")))
    return dc.resolve_placeholders(hidden, res_cache(spark, d)).select("ticker", "accession_number", "name", "pct", "parent", "resolved_by")


@query(
    "stored_resolutions",
    "D-05 S-02",
    with_parts(
        """WITH found AS (SELECT DISTINCT ticker, accession_number, name AS placeholder, parent AS resolved_parent, resolved_by FROM resolved WHERE resolved_by = 'regex')
SELECT ticker, accession_number, placeholder, resolved_parent, resolved_by FROM res_cache c ANTI JOIN found USING (ticker, accession_number, placeholder)
UNION ALL SELECT ticker, accession_number, placeholder, resolved_parent, resolved_by FROM found""",
        "resolved",
        "res_cache",
    ),
)
def _(spark, d):
    h = dc.extract_hits(docs(spark, d))
    hidden = h.filter(dc.match_alias(F.col("name")).isNull() & dc.is_placeholder(F.col("name")))
    cache = res_cache(spark, d)
    stored = dc.with_resolutions(cache, dc.resolve_placeholders(hidden, cache))
    return stored.select("ticker", "accession_number", "placeholder", "resolved_parent", "resolved_by")


part(
    "conc",
    f"""
SELECT ticker, parent, name, pct, resolved_by, accession_number FROM (
 SELECT ticker, accession_number, pass, position, name, pct, {_alias_sql('name')} AS parent, 'explicit' AS resolved_by FROM hits
 UNION ALL SELECT ticker, accession_number, pass, position, name, pct, parent, resolved_by FROM resolved)
WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, parent ORDER BY accession_number, pass, position) = 1""",
    "hits",
    "resolved",
)


@query("concentrations", "D-06", with_parts("SELECT * FROM conc", "conc"))
def _(spark, d):
    return dc.concentrations(docs(spark, d), res_cache(spark, d)).select("ticker", "parent", "name", "pct", "resolved_by", "accession_number")


# ---- gates --------------------------------------------------------------------------

GATE = "2001-12-31"


def _gate(age: str) -> str:
    return f"""SELECT ticker, last_close, {r8s('adv', 4)} AS adv, CAST(age AS BIGINT) AS age_days,
  CASE WHEN last_close < 5 THEN 'price' WHEN adv < 10000000 THEN 'adv' WHEN age < 180 THEN 'listing age' ELSE '' END AS reason
FROM (SELECT ticker, arg_max(close, date) AS last_close, avg(close * volume) AS adv, DATE '{GATE}' - {age} AS age
 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn, min(date) OVER (PARTITION BY ticker) AS first_date FROM nr_bars) WHERE rn <= 21 GROUP BY ticker)"""


@query("liquidity_gate", "D-07", with_parts(_gate("min(date)"), "nr_bars"))
def _(spark, d):
    g = dc.liquidity_gate(inp.series(spark, d, "nation", "region"), GATE)
    return g.select("ticker", "last_close", r8("adv", 4).alias("adv"), F.col("age_days").cast("long").alias("age_days"), "reason")


@query("liquidity_gate_full_history", "D-07", with_parts(_gate("min(first_date)"), "nr_bars"))
def _(spark, d):
    g = dc.liquidity_gate(inp.series(spark, d, "nation", "region"), GATE, "history")
    return g.select("ticker", "last_close", r8("adv", 4).alias("adv"), F.col("age_days").cast("long").alias("age_days"), "reason")


# candidates: every edge, its state set by weight and its date by position
part(
    "cands",
    """
SELECT child AS ticker, parent, CASE WHEN weight >= 0.7::DOUBLE THEN 'STRONG' ELSE 'MEDIUM' END AS dependency_strength, DATE '2000-01-01' - CAST(position % 200 AS INTEGER) AS discovered_date,
  CASE WHEN weight >= 0.85::DOUBLE THEN 'PROMOTED' WHEN weight >= 0.75::DOUBLE THEN 'FAILED' WHEN weight >= 0.55::DOUBLE THEN 'READY_FOR_BACKTEST' ELSE 'ACCUMULATING' END AS status FROM edges""",
    "edges",
)


def cands(spark, d):
    w = F.col("weight")
    return inp.edges(spark, d).select(
        F.col("child").alias("ticker"),
        "parent",
        F.when(w >= 0.7, "STRONG").otherwise("MEDIUM").alias("dependency_strength"),
        F.date_sub(F.lit("2000-01-01").cast("date"), (F.col("position") % 200).cast("int")).alias("discovered_date"),
        F.when(w >= 0.85, "PROMOTED").when(w >= 0.75, "FAILED").when(w >= 0.55, "READY_FOR_BACKTEST").otherwise("ACCUMULATING").alias("status"),
    )


@query(
    "excluded_hits",
    "D-08 J-10",
    with_parts(
        """SELECT ticker, parent, CASE WHEN parent NOT IN ('NVDA', 'TSLA', 'AAPL') THEN 'unknown parent' WHEN ticker IN (SELECT parent FROM edges) THEN 'already active'
 WHEN ticker IN (SELECT ticker FROM cands WHERE status <> 'FAILED') THEN 'already in discovery' WHEN ticker IN (SELECT ticker FROM cands WHERE status = 'FAILED' AND discovered_date >= DATE '2000-01-01' - 90) THEN 'failed recently' ELSE '' END AS reason FROM conc""",
        "conc",
        "edges",
        "cands",
    ),
)
def _(spark, d):
    c = dc.concentrations(docs(spark, d), res_cache(spark, d))
    graph = inp.edges(spark, d).select(F.col("parent").alias("ticker"))
    out = dc.exclusions(c, graph, cands(spark, d), "2000-01-01", ("NVDA", "TSLA", "AAPL"))
    return out.select("ticker", "parent", "reason")


@query(
    "inserted_candidates",
    "D-09 S-03",
    with_parts(
        """SELECT ticker, parent, dependency_strength, status FROM cands UNION ALL SELECT ticker, parent, CASE WHEN pct >= 20 THEN 'STRONG' ELSE 'MEDIUM' END, 'ACCUMULATING' FROM conc""",
        "conc",
        "cands",
    ),
)
def _(spark, d):
    c = dc.concentrations(docs(spark, d), res_cache(spark, d))
    return dc.insert_candidates(c, cands(spark, d), "2000-01-01").select("ticker", "parent", "dependency_strength", "status")


@query(
    "constituent_universe",
    "D-12 T-08",
    with_parts(
        f"""SELECT DISTINCT p_brand AS ticker FROM part WHERE p_brand <> 'Brand#3' UNION
SELECT ticker FROM (SELECT DISTINCT ticker FROM trades WHERE ticker NOT IN (SELECT parent FROM edges) AND ticker NOT IN (SELECT ticker FROM cands WHERE status = 'PROMOTED'))
WHERE ticker NOT IN (SELECT ticker FROM ({_gate('min(date)')}) WHERE reason <> '')""",
        "trades",
        "edges",
        "cands",
        "nr_bars",
    ),
)
def _(spark, d):
    names = inp.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).union(inp.trades(spark, d).select("ticker"))
    graph = inp.edges(spark, d).select(F.col("parent").alias("ticker"))
    return dc.constituent_universe(names, graph, cands(spark, d), inp.series(spark, d, "nation", "region"), ["Brand#3"], GATE)


# ---- life cycle ---------------------------------------------------------------------

part("stored_rs", "SELECT ticker, parent, date, score AS rs_score FROM pic_rows", "pic_rows")


@query(
    "advanced_candidates",
    "D-10 J-09 A-02",
    with_parts(
        """SELECT c.ticker, c.parent, CASE WHEN c.status = 'ACCUMULATING' AND n >= 1200 THEN 'READY_FOR_BACKTEST' ELSE c.status END AS status
FROM cands c LEFT JOIN (SELECT ticker, parent, count(DISTINCT date) AS n FROM stored_rs GROUP BY 1, 2) s USING (ticker, parent)""",
        "cands",
        "stored_rs",
    ),
)
def _(spark, d):
    _own, stored = qb.stored_strength(spark, d)
    return dc.advance_ready(cands(spark, d), stored, 1200).select("ticker", "parent", "status")


part(
    "decided",
    """
SELECT c.ticker, c.parent, c.dependency_strength, c.discovered_date, c.status AS before, CASE WHEN c.status = 'READY_FOR_BACKTEST' THEN CASE WHEN p.ic_h1 > 0.02::DOUBLE AND p.ic_h2 > 0.02::DOUBLE THEN 'PROMOTED' ELSE 'FAILED' END ELSE c.status END AS status, p.ic, p.ic_h1, p.ic_h2
FROM cands c LEFT JOIN pic p USING (ticker, parent)""",
    "cands",
    "pic",
)


def decided(spark, d):
    own, stored = qb.stored_strength(spark, d)
    ics = bt.pair_ic(stored, own, threshold=0.02)
    return cands(spark, d), ics


@query(
    "decided_candidates",
    "D-10 I-16",
    with_parts("SELECT ticker, parent, status FROM decided", "decided"),
)
def _(spark, d):
    before, ics = decided(spark, d)
    return dc.decide(before, ics).select("ticker", "parent", "status")


@query(
    "promoted_edges",
    "D-10",
    with_parts("SELECT parent, ticker AS child, 'systems' AS edge_type, 0.3::DOUBLE AS weight FROM decided WHERE before = 'READY_FOR_BACKTEST' AND status = 'PROMOTED'", "decided"),
)
def _(spark, d):
    before, ics = decided(spark, d)
    return dc.promoted_edges(before, dc.decide(before, ics))


@query(
    "candidate_progress",
    "J-07",
    with_parts(
        f"""SELECT c.ticker, c.parent, c.dependency_strength, count(DISTINCT date) AS days, {r8s('avg(rs_score)')} AS mean_rs FROM cands c LEFT JOIN (SELECT * FROM stored_rs WHERE parent <> 'NATION_4') s USING (ticker, parent) WHERE status = 'ACCUMULATING' GROUP BY 1, 2, 3""",
        "cands",
        "stored_rs",
    ),
)
def _(spark, d):
    _own, stored = qb.stored_strength(spark, d)
    p = dc.candidate_progress(cands(spark, d), stored.filter(F.col("parent") != "NATION_4"))
    return p.withColumn("mean_rs", r8("mean_rs"))


part(
    "r10",
    "SELECT ticker, parent, rs_score, row_number() OVER (PARTITION BY ticker, parent ORDER BY date DESC) AS rn FROM stored_rs QUALIFY rn <= 10",
    "stored_rs",
)
part(
    "trends",
    """
SELECT ticker, parent, l5, p5, CASE WHEN l5 IS NULL OR p5 IS NULL THEN '→' WHEN l5 > p5 + 0.002::DOUBLE THEN '↑' WHEN l5 < p5 - 0.002::DOUBLE THEN '↓' ELSE '→' END AS trend
FROM (SELECT r.ticker, r.parent, avg(r.rs_score) FILTER (r.rn <= 5) AS l5, avg(r.rs_score) FILTER (NOT r.dup) AS p5
 FROM (SELECT *, bool_or(rn <= 5) OVER (PARTITION BY ticker, parent, rs_score) AS dup FROM r10) r GROUP BY 1, 2)""",
    "r10",
)


@query(
    "accumulation_trend",
    "W-20",
    with_parts(f"SELECT ticker, parent, {r8s('l5')} AS last5, {r8s('p5')} AS prior5, trend FROM trends", "trends"),
)
def _(spark, d):
    _own, stored = qb.stored_strength(spark, d)
    return dc.accum_trend(stored).withColumns({"last5": r8("last5"), "prior5": r8("prior5")})


@query(
    "discovery_panel",
    "D-11 J-07 J-08",
    with_parts(
        f"""WITH prog AS (SELECT c.ticker, c.parent, c.status, count(DISTINCT date) AS days, avg(rs_score) AS m FROM cands c LEFT JOIN stored_rs s USING (ticker, parent) GROUP BY 1, 2, 3),
done AS (SELECT ticker, parent, ic_h1, CASE WHEN parent = 'NATION_3' THEN DATE '2000-01-01' - 60 ELSE DATE '2000-01-01' END AS run_date FROM pic)
SELECT 'accumulating' AS section, p.ticker, p.parent, days, {r8s('m')} AS value, coalesce(trend, '→') AS trend FROM prog p LEFT JOIN trends t USING (ticker, parent) WHERE status = 'ACCUMULATING'
UNION ALL SELECT 'ready', ticker, parent, days, NULL, NULL FROM prog WHERE status = 'READY_FOR_BACKTEST'
UNION ALL SELECT lower(status), c.ticker, c.parent, NULL, {r8s('ic_h1')}, NULL FROM cands c JOIN done USING (ticker, parent) WHERE status IN ('PROMOTED', 'FAILED') AND run_date >= DATE '2000-01-01' - 30
UNION ALL SELECT 'new', ticker, parent, NULL, NULL, NULL FROM cands WHERE discovered_date >= DATE '2000-01-01' - 7""",
        "cands",
        "stored_rs",
        "trends",
        "pic",
    ),
)
def _(spark, d):
    own, stored = qb.stored_strength(spark, d)
    base = F.lit("2000-01-01").cast("date")
    run = F.when(F.col("parent") == "NATION_3", F.date_sub(base, 60)).otherwise(base)
    results = bt.pair_ic(stored, own).withColumn("run_date", run)
    return dc.discovery_panel(cands(spark, d), stored, results, "2000-01-01").withColumn("value", r8("value"))


# ---- research: baskets --------------------------------------------------------------


def baskets(spark, d):
    return inp.themes(spark, d).select("theme", "ticker", "benchmark", F.substring("ticker", 8, 9).cast("long").alias("position"))


def split(spark, d):
    allb = inp.series(spark, d, "nation", "market")
    return allb.filter(F.col("ticker") != inp.MARKET), allb.filter(F.col("ticker") == inp.MARKET)


part(
    "bk",
    """
SELECT q.*, (r20 - avg(r20) OVER g) / nullif(stddev_pop(r20) OVER g, 0) AS z FROM (SELECT t.theme, t.benchmark, CAST(substr(b.ticker, 8) AS BIGINT) AS position, b.ticker, b.date, b.r20, b.rv, b.s20 AS fwd,
 count(*) OVER (PARTITION BY t.theme, b.date) AS members FROM bt b JOIN themes t ON t.ticker = b.ticker WHERE r20 IS NOT NULL) q WHERE members >= 3 WINDOW g AS (PARTITION BY theme, date)""",
    "bt",
    "themes",
)
_zof = lambda c, n: f"CASE WHEN count({c}) OVER g >= 2 THEN ({c} - avg({c}) OVER g) / nullif(stddev_pop({c}) OVER g, 0) END AS {n}"
part(
    "blume",
    f"""
SELECT *, z * rv AS combined_base, z * rv * z_beta AS combined_beta, z * rv * z_blume AS combined_blume FROM (SELECT *, {_zof('beta', 'z_beta')}, {_zof('bl', 'z_blume')} FROM (
 SELECT b.*, e.beta, e.beta * 0.67::DOUBLE + 0.33::DOUBLE AS bl FROM bk b LEFT JOIN betas e ON e.ticker = b.ticker AND e.date = b.date WHERE z IS NOT NULL) WINDOW g AS (PARTITION BY theme, date)) WHERE fwd IS NOT NULL""",
    "bk",
    "betas",
)


@query(
    "shrunken_beta_signals",
    "G-27",
    with_parts(
        f"SELECT theme, ticker, date, {', '.join(f'{r8s(a, 5)} AS {b}' for a, b in (('z', 'z_rs'), ('beta', 'beta_raw'), ('bl', 'beta_blume'), ('z_beta', 'z_beta'), ('combined_base', 'combined_base'), ('combined_blume', 'combined_blume')))} FROM blume",
        "blume",
    ),
)
def _(spark, d):
    own, market = split(spark, d)
    b = rs.blume_signals(own, baskets(spark, d), market)
    return b.select("theme", "ticker", "date", *[r8(c, 5).alias(c) for c in ("z_rs", "beta_raw", "beta_blume", "z_beta", "combined_base", "combined_blume")])


part(
    "variant_ic",
    f"""
SELECT * FROM {halves_sql(f"(SELECT theme, variant, date, position, half, fwd, CASE variant WHEN 'base' THEN combined_base WHEN 'beta' THEN combined_beta ELSE combined_blume END AS score FROM {half_sql('blume', 'theme')}, (VALUES ('base'), ('beta'), ('blume')) v(variant))", 'theme, variant', 'ordinal', 30, 'date, position')}""",
    "blume",
)


@query(
    "beta_variant_ics",
    "I-19 I-17",
    with_parts(
        f"""SELECT theme, variant, n, {r8s('ic', 5)} AS ic, {r8s('ic_h1', 5)} AS ic_h1, {r8s('ic_h2', 5)} AS ic_h2 FROM variant_ic""",
        "variant_ic",
    ),
)
def _(spark, d):
    own, market = split(spark, d)
    v = rs.beta_variant_ics(rs.blume_signals(own, baskets(spark, d), market))
    return v.select("theme", "variant", "n", *[r8(c, 5).alias(c) for c in ("ic", "ic_h1", "ic_h2")])


@query(
    "beta_variant_verdict",
    "I-19 I-17",
    with_parts(
        f"""WITH w AS (SELECT v.theme, arg_max(v.variant, v.ic) AS winner, max(v.ic) - max(CASE WHEN v.variant = 'base' THEN v.ic END) AS gain,
  coalesce(arg_max(v.ic_h2, v.ic) > max(CASE WHEN v.variant = 'base' THEN v.ic_h2 END), FALSE) AS up FROM variant_ic v WHERE v.ic IS NOT NULL GROUP BY 1)
SELECT {r8s('avg(gain)', 5)} AS mean_gain, count(*) FILTER (up) AS h2_improved, count(*) AS n_baskets, CASE WHEN count(*) = 0 THEN 'INSUFFICIENT DATA' WHEN avg(gain) > 0.01 AND count(*) FILTER (up) >= count(*) / 2 THEN 'YES' ELSE 'NO' END AS verdict FROM w""",
        "variant_ic",
    ),
)
def _(spark, d):
    own, market = split(spark, d)
    v = rs.beta_variant_ics(rs.blume_signals(own, baskets(spark, d), market))
    return rs.beta_variant_recommendation(v)[1].withColumn("mean_gain", r8("mean_gain", 5))


@query(
    "beta_diagnostics",
    "G-28",
    with_parts(
        f"""WITH c AS (SELECT theme, max(date) AS date FROM (SELECT theme, date FROM bars JOIN themes USING (ticker) GROUP BY theme, date HAVING count(DISTINCT ticker) = 5) GROUP BY 1),
q AS (SELECT t.theme, t.ticker, c.date, beta, beta * 0.67::DOUBLE + 0.33::DOUBLE AS bl FROM themes t JOIN c USING (theme) LEFT JOIN betas e ON e.ticker = t.ticker AND e.date = c.date)
SELECT theme, ticker, date, {r8s('beta', 6)} AS beta_raw, {r8s('bl', 6)} AS beta_blume, {r8s('z_beta', 5)} AS z_beta FROM (SELECT *, {_zof('beta', 'z_beta')} FROM q WINDOW g AS (PARTITION BY theme))""",
        "bars",
        "themes",
        "betas",
    ),
)
def _(spark, d):
    own, market = split(spark, d)
    b = rs.beta_diagnostics(own, inp.themes(spark, d), market)
    return b.select("theme", "ticker", "date", r8("beta", 6).alias("beta_raw"), r8("beta_blume", 6).alias("beta_blume"), r8("z_beta", 5).alias("z_beta"))


part(
    "bk_long",
    """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY theme, name, signal ORDER BY position, date) - 1 < count(*) OVER (PARTITION BY theme, name, signal) // 2 THEN 'H1' ELSE 'H2' END AS half FROM (
SELECT theme, unnest([ticker, 'BASKET']) AS name, position, date, fwd, signal, CASE signal WHEN 'rs' THEN rs WHEN 'z' THEN z ELSE z * rv END AS score
 FROM (SELECT b.*, b.r20 - n.r AS rs FROM bk b LEFT JOIN nr20 n ON n.ticker = b.benchmark AND n.date = b.date WHERE fwd IS NOT NULL), (VALUES ('rs'), ('z'), ('combined')) s(signal)) WHERE score IS NOT NULL""",
    "bk",
    "nr20",
)


@query(
    "basket_research",
    "I-18",
    with_parts(
        f"""SELECT theme, name, signal, n, {r8s('ic')} AS ic, {r8s("CASE WHEN signal = 'combined' AND n >= 40 THEN ic_h1 END")} AS ic_h1, {r8s("CASE WHEN signal = 'combined' AND n >= 40 THEN ic_h2 END")} AS ic_h2,
 coalesce(name = 'BASKET' AND signal = 'combined' AND n >= 40 AND i.ic_h1 > 0.05::DOUBLE AND i.ic_h2 > 0.05::DOUBLE, FALSE) AS validated FROM {halves_sql('bk_long', 'theme, name, signal', 'ordinal', 5, 'position, date')} i""",
        "bk_long",
    ),
)
def _(spark, d):
    b = rs.basket_research(inp.series(spark, d, "nation", "region"), baskets(spark, d))
    return b.select("theme", "name", "signal", "n", *[r8(c).alias(c) for c in ("ic", "ic_h1", "ic_h2")], "validated")


# ---- research: raw against adjusted -------------------------------------------------

part(
    "dbeta",
    f"""
SELECT ticker, date, CASE WHEN count(x) OVER f = 60 THEN covar_samp(x, y) OVER f / nullif(var_samp(y) OVER f, 0) END AS beta FROM (
 SELECT b.ticker, b.date, b.r AS x, m.m AS y FROM tret b JOIN mret m USING (date) WHERE b.r IS NOT NULL AND m.m IS NOT NULL)
WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "tret",
    "mret",
)
part(
    "ra",
    """
SELECT c.ticker, e.parent, c.date, c.r20 - p.r20 AS raw, (c.r20 - cb.beta * m.m) - (p.r20 - pb.beta * m.m) AS adj, c.s20 AS fwd, p.r20 AS parent_20d, cb.beta
FROM bt c JOIN edges e ON e.child = c.ticker JOIN bt p ON p.ticker = e.parent AND p.date = c.date JOIN mr20 m ON m.date = c.date
LEFT JOIN dbeta cb ON cb.ticker = c.ticker AND cb.date = c.date LEFT JOIN dbeta pb ON pb.ticker = e.parent AND pb.date = c.date
WHERE c.s20 IS NOT NULL AND c.r20 IS NOT NULL AND p.r20 IS NOT NULL""",
    "bt",
    "edges",
    "mr20",
    "dbeta",
)
part(
    "ra_long",
    "SELECT * FROM (SELECT ticker, parent, date, fwd, parent_20d, adj, signal, CASE signal WHEN 'raw' THEN raw ELSE adj END AS score FROM ra, (VALUES ('raw'), ('adj')) s(signal)) WHERE score IS NOT NULL",
    "ra",
)
part(
    "ra_ic",
    f"""
SELECT * FROM {halves_sql("(SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker, parent, signal ORDER BY date) - 1 < count(*) OVER (PARTITION BY ticker, parent, signal) // 2 THEN 'H1' ELSE 'H2' END AS half FROM ra_long)", 'ticker, parent, signal', 'average', 5)}""",
    "ra_long",
)
part(
    "ra_cmp",
    """
SELECT r.ticker, r.parent, r.n AS raw_n, a.n AS adj_n, r.ic AS raw_ic, a.ic AS adj_ic, abs(r.ic_h2 - r.ic_h1) AS raw_gap, abs(a.ic_h2 - a.ic_h1) AS adj_gap, corr, avg_beta
FROM ra_ic r JOIN ra_ic a ON a.ticker = r.ticker AND a.parent = r.parent AND a.signal = 'adj' JOIN (SELECT ticker, parent, CASE WHEN count(*) >= 5 THEN covar_pop(raw, adj) / nullif(stddev_pop(raw) * stddev_pop(adj), 0) END AS corr, avg(beta) AS avg_beta FROM ra WHERE adj IS NOT NULL GROUP BY 1, 2) c ON c.ticker = r.ticker AND c.parent = r.parent
WHERE r.signal = 'raw'""",
    "ra_ic",
    "ra",
)


def ra_obs(spark, d):
    own, market = split(spark, d)
    pairs = inp.edges(spark, d).select(F.col("child").alias("ticker"), "parent")
    return rs.raw_adjusted_obs(own, pairs, market), market


@query(
    "raw_vs_adjusted",
    "I-20 A-07 I-17",
    with_parts(
        f"""SELECT ticker, parent, raw_n, adj_n, {', '.join(f'{r8s(c, 6)} AS {o}' for c, o in (('raw_ic', 'raw_ic'), ('adj_ic', 'adj_ic'), ('raw_gap', 'raw_gap'), ('adj_gap', 'adj_gap'), ('corr', 'signal_corr'), ('avg_beta', 'avg_beta')))},
 CASE WHEN c.raw_ic IS NULL OR c.adj_ic IS NULL THEN 'n/a' WHEN abs(abs(c.adj_ic) - abs(c.raw_ic)) < 0.01::DOUBLE THEN CASE WHEN c.raw_gap IS NULL OR c.adj_gap IS NULL THEN 'Tie' WHEN c.adj_gap < c.raw_gap THEN 'Adj' ELSE 'Raw' END
  WHEN abs(c.adj_ic) > abs(c.raw_ic) THEN 'Adj' ELSE 'Raw' END AS winner FROM ra_cmp c""",
        "ra_cmp",
    ),
)
def _(spark, d):
    c = rs.raw_vs_adjusted(ra_obs(spark, d)[0])
    return c.select("ticker", "parent", "raw_n", "adj_n", *[r8(x, 6).alias(x) for x in ("raw_ic", "adj_ic", "raw_gap", "adj_gap", "signal_corr", "avg_beta")], "winner")


part(
    "ra_regime",
    f"""
SELECT ticker, parent, regime, max(CASE WHEN signal = 'adj' THEN n END) AS n, max(CASE WHEN signal = 'raw' THEN ic END) AS raw_ic, max(CASE WHEN signal = 'adj' THEN ic END) AS adj_ic FROM {ic_sql("(SELECT *, CASE WHEN parent_20d > 0.10::DOUBLE THEN 'STRONG_UP' WHEN parent_20d > 0.02::DOUBLE THEN 'UP' WHEN parent_20d >= -0.02::DOUBLE THEN 'FLAT' WHEN parent_20d > -0.05::DOUBLE THEN 'MILD_PULLBACK' WHEN parent_20d >= -0.15::DOUBLE THEN 'CORRECTION' ELSE 'CRASH' END AS regime FROM ra_long WHERE adj IS NOT NULL)", 'ticker, parent, regime, signal', 'average', 30)} GROUP BY 1, 2, 3""",
    "ra_long",
)


@query(
    "regime_comparison",
    "I-20",
    with_parts(f"SELECT ticker, parent, regime, n, {r8s('raw_ic', 6)} AS raw_ic, {r8s('adj_ic', 6)} AS adj_ic FROM ra_regime", "ra_regime"),
)
def _(spark, d):
    r = rs.regime_comparison(ra_obs(spark, d)[0])
    return r.select("ticker", "parent", "regime", "n", r8("raw_ic", 6).alias("raw_ic"), r8("adj_ic", 6).alias("adj_ic"))


@query(
    "edge_keep_verdicts",
    "I-17 I-20",
    with_parts(
        """SELECT c.ticker, c.parent, CASE WHEN c.adj_ic IS NULL THEN 'INSUFFICIENT DATA' WHEN c.adj_ic > 0.10::DOUBLE THEN 'KEEP' WHEN r.adj_ic > 0.10::DOUBLE THEN 'KEEP (regime value)'
 WHEN c.adj_ic < 0.05::DOUBLE AND (r.adj_ic IS NULL OR r.adj_ic < 0.05::DOUBLE) THEN 'CONSIDER DROPPING' ELSE 'MARGINAL' END AS verdict
FROM ra_cmp c LEFT JOIN (SELECT * FROM ra_regime WHERE regime = 'CORRECTION') r USING (ticker, parent)""",
        "ra_cmp",
        "ra_regime",
    ),
)
def _(spark, d):
    obs = ra_obs(spark, d)[0]
    return rs.keep_verdict(rs.raw_vs_adjusted(obs), rs.regime_comparison(obs)).select("ticker", "parent", "verdict")


@query(
    "macro_shift_days",
    "I-20 T-07",
    with_parts(
        f"""SELECT ticker, parent, date, {r8s('raw', 7)} AS raw, {r8s('adj', 7)} AS adj, {r8s('raw - adj', 7)} AS diff, {r8s('m')} AS move FROM ra a JOIN (SELECT date, m FROM mret WHERE m IS NOT NULL ORDER BY abs(m) DESC, date LIMIT 10) USING (date) WHERE adj IS NOT NULL""".replace("FROM ra a", "FROM (SELECT ticker, parent, date, raw, adj FROM ra) a"),
        "ra",
        "mret",
    ),
)
def _(spark, d):
    obs, market = ra_obs(spark, d)
    m = rs.macro_shift_days(obs, market)
    return m.select("ticker", "parent", "date", *[r8(c, 7).alias(c) for c in ("raw", "adj", "diff")], r8("move").alias("move"))
