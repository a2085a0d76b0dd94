"""Candidate discovery: filing text to dependency edges, and the candidates' life cycle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.operators.ranking import top_n
from crosstide.session import reliable_checkpoint
from crosstide.sources.tables import insert_ignore, new_rows, upsert

# ---- fixed values: patterns, names, clues and limits that decide results --------------

# a name of up to 60 characters before the words that tell
NAME_BEFORE = r"(.{3,60}?)\s+"
# name first, percentage second, except where marked
CONCENTRATION_PATTERNS = (
    (r"(.{3,60}?)\s+accounted\s+for\s+(?:approximately\s+)?(\d+(?:\.\d+)?)\s*%\s+of\s+(?:our\s+)?(?:total\s+)?(?:net\s+)?revenue", 1, 2),
    (
        r"(\d+(?:\.\d+)?)\s*%\s+of\s+(?:our\s+)?(?:total\s+)?(?:net\s+)?revenue\s+(?:was\s+)?(?:from|derived\s+from)\s+(.{3,60}?)[,\.]",
        2,
        1,
    ),
    (r"(.{3,60}?)\s+represented\s+(?:approximately\s+)?(\d+(?:\.\d+)?)\s*%\s+of\s+(?:our\s+)?(?:total\s+)?(?:net\s+)?revenue", 1, 2),
    (r"(.{3,60}?)\s+was\s+responsible\s+for\s+(?:approximately\s+)?(\d+(?:\.\d+)?)\s*%\s+of\s+(?:our\s+)?(?:total\s+)?revenue", 1, 2),
    (r"revenue\s+concentration\s+of\s+(\d+(?:\.\d+)?)\s*%\s+(?:from|with)\s+(.{3,60}?)[,\.]", 2, 1),
)
TABLE_ROW_PATTERN = r"^\s*\|\s*([^|]{3,60}?)\s*\|\s*(\d+(?:\.\d+)?)\s*%"
PLACEHOLDER_PATTERNS = (
    r"^Customer\s+[A-Z]$",
    r"^Customer\s+\d+$",
    r"^(?:a|one)\s+(?:single\s+)?customer$",
    r"^(?:our\s+)?(?:largest|primary|key|significant)\s+customer$",
    r"^(?:one|a)\s+(?:large|major)\s+customer$",
)
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
# white space and line ends are those of Unicode: filings are full of no-break spaces and form feeds
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"  # besides \n; \r\n is one

PARENT_ALIASES = {
    "NVDA": ["NVIDIA", "NVIDIA Corporation", "NVIDIA Corp"],
    "MSFT": ["Microsoft", "Microsoft Corporation", "Azure"],
    "META": ["Meta", "Meta Platforms", "Facebook", "Instagram"],
    "AAPL": ["Apple", "Apple Inc", "App Store"],
    "AMZN": ["Amazon", "Amazon.com", "AWS", "Amazon Web Services"],
    "GOOGL": ["Google", "Alphabet", "Google LLC", "YouTube"],
    "TSLA": ["Tesla", "Tesla Inc", "Tesla Motors"],
    "AVGO": ["Broadcom", "Broadcom Inc", "Broadcom Corporation"],
    "ORCL": ["Oracle", "Oracle Corporation"],
    "TSM": ["TSMC", "Taiwan Semiconductor", "Taiwan Semiconductor Manufacturing"],
}
CONTEXT_CLUES = {
    "NVDA": [
        "GPU", "graphics processing", "data center GPU", "H100", "A100",
        "Blackwell", "Hopper", "NVLink", "CUDA", "accelerated computing",
    ],
    "TSLA": [
        "electric vehicle", "EV", "silicon carbide", "SiC",
        "autopilot", "battery electric", "drivetrain", "powertrain",
    ],
    "AAPL": ["iPhone", "App Store", "iOS", "Mac", "AirPods", "Apple Watch", "iPad"],
    "AMZN": ["AWS", "Amazon Web Services", "Prime", "Alexa", "Kindle", "fulfillment center"],
    "MSFT": ["Azure", "Office 365", "Teams", "Xbox", "Windows", "Dynamics", "GitHub"],
    "META": ["Facebook", "Instagram", "WhatsApp", "Oculus", "Reality Labs", "metaverse"],
    "GOOGL": ["Google Search", "YouTube", "AdWords", "AdSense", "Google Cloud", "Android", "Chrome"],
    "AVGO": ["custom AI accelerator", "XPU", "networking ASIC", "Tomahawk", "Jericho"],
    "ORCL": ["Oracle Cloud", "OCI", "Oracle Database", "Oracle ERP"],
    "TSM": ["semiconductor fabrication", "wafer fabrication", "foundry services", "advanced node"],
}
KNOWN_PARENTS = ("NVDA", "MSFT", "META", "AAPL", "AMZN", "GOOGL", "GOOG", "TSLA", "AVGO", "ORCL", "TSM")

MIN_PCT = 10.0
STRONG_PCT = 20.0
CLUE_HITS = 2
CLUE_CONFIDENCE = 0.85
MIN_PRICE = 5.0
MIN_ADV = 10_000_000.0
MIN_LIST_DAYS = 180
ADV_ROWS = 21
FAILED_DAYS = 90
READY_DAYS = 60
PROMOTED_WEIGHT = 0.3

# ---- extraction ---------------------------------------------------------------------


def _group(text: Column, pattern: str, k: int) -> Column:
    """Group of the first match, NULL without one; no group of a match is empty.

    A match takes in the rest of the text, so there is at most one. A pattern that starts with a name would try every
    length of it at every place of the text, so the words after the name, which any match contains, are looked for first.
    """
    found = F.get(F.regexp_extract_all(text, F.lit(f"(?iU){pattern}(?s:.*+)"), F.lit(k)), F.lit(0))
    if pattern.startswith(NAME_BEFORE):
        return F.when(text.rlike("(?iU)" + pattern.removeprefix(NAME_BEFORE)), found)
    return found


def _clean(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?U)\s+", " "))


def _lines(text: Column) -> Column:
    """Lines of a text; a split at one plain character needs no pattern, which Spark would compile for every row."""
    return F.split(F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS)), "\n")


def _hits(number: int, texts: Column, possible, patterns) -> Column:
    """Array of (pass, position, name, pct) of the texts with a match; the first pattern that matches counts."""

    def named(t, i):
        name = F.when(possible(t), F.coalesce(*[_group(t, p, n) for p, n, _ in patterns]))
        return F.struct(i.alias("position"), t.alias("text"), name.alias("name"))

    def hit(h):
        pct = F.coalesce(*[_group(h["text"], p, k) for p, _, k in patterns]).try_cast("double")
        return F.struct(F.lit(number).alias("pass"), h["position"].alias("position"), _clean(h["name"]).alias("name"), pct.alias("pct"))

    return F.transform(F.filter(F.transform(texts, named), lambda h: h["name"].isNotNull()), hit)


def table_rows(text: Column) -> Column:
    """Hits of pipe-delimited rows: array of (pass, position, name, pct).

    Texts and lines without a bar and a percent sign cannot match and skip the pattern.
    """
    possible = lambda t: t.contains("|") & t.contains("%")
    lines = F.when(possible(text), _lines(text)).otherwise(F.array().cast("array<string>"))
    return _hits(1, lines, possible, [(TABLE_ROW_PATTERN, 1, 2)])


def sentence_hits(sentences: Column) -> Column:
    """Hits of prose sentences; only the first matching pattern of a sentence counts.

    Every pattern needs a percent sign, so other sentences skip them all.
    """
    return _hits(2, sentences, lambda t: t.contains("%"), CONCENTRATION_PATTERNS)


def split_sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def extract_hits(docs: DataFrame, min_pct: float = MIN_PCT) -> DataFrame:
    """Customer concentrations of each document, table rows first.

    ``docs`` has ticker, accession_number, business and risk_factors. Everything is
    found inside the document's own row, so no text is shuffled; only hits are exploded. Names are cleaned before
    that, as a filter on a name would repeat the cleaning in each of its tests.
    ``text`` stays next to a hit for resolving placeholders.
    """
    sections = F.concat_ws("\n\n", F.nullif("business", F.lit("")), F.nullif("risk_factors", F.lit("")))
    staged = docs.select("ticker", "accession_number", sections.alias("_text"), _all_text().alias("_all"))
    hits = F.filter(
        F.concat(table_rows(F.col("_text")), sentence_hits(split_sentences(F.col("_text")))),
        lambda h: h["pct"] >= min_pct,
    )
    rows = staged.withColumn("_h", F.explode(hits))
    return rows.select(
        "ticker",
        "accession_number",
        F.col("_h.pass").alias("pass"),
        F.col("_h.position").alias("position"),
        F.col("_h.name").alias("name"),
        F.col("_h.pct").alias("pct"),
        F.col("_all").alias("text"),
    )


def _all_text() -> Column:
    return F.concat(F.coalesce("business", F.lit("")), F.lit("\n\n"), F.coalesce("risk_factors", F.lit("")))


def match_alias(name: Column, aliases: Mapping[str, Sequence[str]] = PARENT_ALIASES) -> Column:
    """First parent, in dictionary order, with an alias inside the name or the name inside an alias.

    The lower-case name is bound once for all tests.
    """

    def parent_of(low):
        out = F.lit(None).cast("string")
        for parent, words in reversed(list(aliases.items())):
            near = F.lit(False)
            for w in words:
                near = near | low.contains(w.lower()) | F.contains(F.lit(w.lower()), low)
            out = F.when(near, parent).otherwise(out)
        return out

    return F.get(F.transform(F.array(F.lower(F.trim(name))), parent_of), F.lit(0))


def is_placeholder(name: Column) -> Column:
    """True for an anonymised customer name."""
    clean = F.trim(name)
    out = F.lit(False)
    for p in PLACEHOLDER_PATTERNS:
        out = out | clean.rlike("(?i)" + p)
    return out


def clue_window(sentences: Column, name: Column) -> Column:
    """Lower-case text from one sentence before the first mention of ``name`` to three after; '' if absent."""
    low = F.lower(name)
    mention = F.array_position(F.transform(sentences, lambda s: F.contains(F.lower(s), low)), F.lit(True))
    start = F.greatest(mention - 1, F.lit(1))
    length = F.least(F.size(sentences), mention + 3) - start + 1
    around = F.slice(sentences, start.cast("int"), length.cast("int"))
    return F.when(mention > 0, F.lower(F.array_join(around, " "))).otherwise("")


def clue_parent(window: Column, clues: Mapping[str, Sequence[str]] = CONTEXT_CLUES) -> Column:
    """Parent with most clues in the window; NULL below two, the earlier parent on a tie."""
    counts = F.array(
        *[
            F.struct(
                sum((window.contains(w.lower()).cast("int") for w in words[1:]), window.contains(words[0].lower()).cast("int")).alias("hits"),
                F.lit(-i).alias("order"),
                F.lit(p).alias("parent"),
            )
            for i, (p, words) in enumerate(clues.items())
        ]
    )
    best = F.array_max(counts)
    return F.when(best["hits"] >= CLUE_HITS, best["parent"])


def resolve_placeholders(
    hits: DataFrame, cache: DataFrame, clues: Mapping[str, Sequence[str]] = CONTEXT_CLUES
) -> DataFrame:
    """Parent, confidence and source of anonymised hits; hits with a parent already pass as explicit.

    A stored resolution comes first, then context clues. Stored rows marked unresolved
    are tried again; a stored row without parent stays so.
    """
    if "parent" not in hits.columns:
        hits = hits.withColumn("parent", F.lit(None).cast("string"))
    known = cache.filter(F.col("resolved_by") != "unresolved").select(
        "ticker",
        "accession_number",
        F.col("placeholder").alias("name"),
        F.struct("resolved_parent", "confidence", "resolved_by").alias("_c"),
    )
    explicit = F.col("parent").isNotNull()
    rows = hits.withColumn("_s", F.when(~explicit, split_sentences(F.col("text"))))
    rows = rows.withColumn("_w", clue_window(F.col("_s"), F.col("name")))
    rows = rows.withColumn("_p", clue_parent(F.col("_w"), clues)).drop("text", "_s", "_w")
    rows = rows.join(known, ["ticker", "accession_number", "name"], "left")
    stored, clued = F.col("_c").isNotNull(), F.col("_p").isNotNull()
    return rows.select(
        "ticker",
        "accession_number",
        "pass",
        "position",
        "name",
        "pct",
        F.when(explicit, F.col("parent")).when(stored, F.col("_c.resolved_parent")).otherwise(F.col("_p")).alias("parent"),
        F.when(explicit, 1.0)
        .when(stored, F.coalesce("_c.confidence", F.lit(0.0)))
        .when(clued, CLUE_CONFIDENCE)
        .otherwise(0.0)
        .alias("confidence"),
        F.when(explicit, "explicit")
        .when(stored, F.col("_c.resolved_by"))
        .when(clued, "regex")
        .otherwise("unresolved")
        .alias("resolved_by"),
    )


def with_resolutions(cache: DataFrame, resolved: DataFrame) -> DataFrame:
    """The cache with what context clues have resolved, one row per (ticker, accession_number, placeholder).

    A stored row without a resolution is replaced. What stays unresolved is not stored, so it is
    tried again; the other stored rows are kept as they are. What is found is kept in the checkpoint
    folder, as the upsert reads it twice and the texts should be read once.
    """
    found = resolved.filter(F.col("resolved_by") == "regex").select(
        "ticker", "accession_number", F.col("name").alias("placeholder"), F.col("parent").alias("resolved_parent"), "confidence", "resolved_by"
    )
    return upsert(cache, reliable_checkpoint(found), ["ticker", "accession_number", "placeholder"])


def concentrations(
    docs: DataFrame,
    cache: DataFrame,
    aliases: Mapping[str, Sequence[str]] = PARENT_ALIASES,
    clues: Mapping[str, Sequence[str]] = CONTEXT_CLUES,
) -> DataFrame:
    """First hit per (ticker, parent): explicit names and resolved placeholders in document order.

    One pass over the texts; what is shuffled are the hits' few columns.
    """
    hits = extract_hits(docs).withColumn("parent", match_alias(F.col("name"), aliases))
    hits = hits.filter(F.col("parent").isNotNull() | is_placeholder(F.col("name")))
    resolved = resolve_placeholders(hits, cache, clues)
    return first_hit(resolved.filter(F.col("parent").isNotNull()))


def first_hit(hits: DataFrame) -> DataFrame:
    """One row per (ticker, parent): the first by document, pass and position."""
    order = F.struct("accession_number", "pass", "position")
    row = F.min_by(F.struct("accession_number", "name", "pct", "resolved_by"), order)
    return hits.groupBy("ticker", "parent").agg(row.alias("_h")).select("ticker", "parent", "_h.*")


# ---- gates --------------------------------------------------------------------------


def liquidity_gate(bars: DataFrame, as_of, age_source: str = "window21") -> DataFrame:
    """Last close, mean traded value of the newest 21 rows, age and the reason a ticker fails.

    ``window21`` takes the age from the oldest of those 21 rows; ``history`` from the first bar.
    """
    if age_source not in ("window21", "history"):
        raise ValueError(f"unknown age source {age_source!r}")
    past = bars.filter(F.col("date") <= F.lit(as_of).cast("date"))
    newest = top_n(past.select("ticker", "date", "close", "volume"), ["ticker"], [F.desc("date")], ADV_ROWS)
    stats = newest.groupBy("ticker").agg(
        F.max_by("close", "date").alias("last_close"),
        F.avg(F.col("close") * F.col("volume")).alias("adv"),
        F.min("date").alias("oldest"),
    )
    if age_source == "history":
        stats = stats.drop("oldest").join(past.groupBy("ticker").agg(F.min("date").alias("oldest")), "ticker")
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("oldest"))
    return stats.withColumn("age_days", age).withColumn(
        "reason",
        F.when(F.col("last_close") < MIN_PRICE, "price")
        .when(F.col("adv") < MIN_ADV, "adv")
        .when(F.col("age_days") < MIN_LIST_DAYS, "listing age")
        .otherwise(""),
    )


def exclusions(
    hits: DataFrame, graph: DataFrame, candidates: DataFrame, as_of, known_parents: Sequence[str] = KNOWN_PARENTS
) -> DataFrame:
    """``reason`` a hit is skipped, empty when it may proceed.

    ``graph`` has one column ticker; failed candidates become eligible again after 90 days.
    """
    one = lambda df, name: df.select("ticker").distinct().withColumn(name, F.lit(True))
    recent = F.col("discovered_date") >= F.date_sub(F.lit(as_of).cast("date"), FAILED_DAYS)
    rows = (
        hits.join(one(graph, "_g"), "ticker", "left")
        .join(one(candidates.filter(F.col("status") != "FAILED"), "_a"), "ticker", "left")
        .join(one(candidates.filter((F.col("status") == "FAILED") & recent), "_f"), "ticker", "left")
    )
    return rows.withColumn(
        "reason",
        F.when(~F.col("parent").isin(*known_parents), "unknown parent")
        .when(F.col("_g"), "already active")
        .when(F.col("_a"), "already in discovery")
        .when(F.col("_f"), "failed recently")
        .otherwise(""),
    ).drop("_g", "_a", "_f")


def insert_candidates(hits: DataFrame, candidates: DataFrame, as_of) -> DataFrame:
    """Candidates with the new hits: STRONG from 20 %, else MEDIUM, all ACCUMULATING.

    The hits, one row per (ticker, parent), are kept in the checkpoint folder: the insert reads them twice.
    """
    rows = hits.select(
        "ticker",
        "parent",
        F.when(F.col("pct") >= STRONG_PCT, "STRONG").otherwise("MEDIUM").alias("dependency_strength"),
        F.col("pct").alias("revenue_pct"),
        F.concat(F.lit("etf_10k_"), "resolved_by").alias("source_accession"),
        F.lit(as_of).cast("date").alias("discovered_date"),
        F.lit("ACCUMULATING").alias("status"),
    )
    return insert_ignore(candidates, reliable_checkpoint(rows), ["ticker", "parent"])


def constituent_universe(
    constituents: DataFrame, graph: DataFrame, candidates: DataFrame, bars: DataFrame, known_parents: Sequence[str], as_of
) -> DataFrame:
    """Distinct fund constituents that are no parent, not in the graph, not promoted and liquid.

    Tickers without any bar pass the price test.
    """
    names = constituents.filter((F.col("ticker") != "") & ~F.col("ticker").isin(*known_parents)).select("ticker").distinct()
    taken = graph.select("ticker").union(candidates.filter(F.col("status") == "PROMOTED").select("ticker")).distinct()
    illiquid = liquidity_gate(bars, as_of).filter(F.col("reason") != "").select("ticker")
    return names.join(taken, "ticker", "left_anti").join(illiquid, "ticker", "left_anti")


# ---- life cycle ---------------------------------------------------------------------


def sync_edges(graph: DataFrame, edges: DataFrame, as_of) -> DataFrame:
    """Graph table with every configured edge present as ACTIVE; stored rows stay as they are."""
    rows = edges.filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).select(
        F.col("child").alias("ticker"),
        "parent",
        F.lit("static").alias("source"),
        F.lit(as_of).cast("date").alias("validated_date"),
        F.lit("ACTIVE").alias("status"),
        "position",
    )
    added = new_rows(graph, rows, ["ticker", "parent"], ["position"]).drop("position")
    return graph.unionByName(added, allowMissingColumns=True)


def advance_ready(candidates: DataFrame, rs: DataFrame, days: int = READY_DAYS) -> DataFrame:
    """ACCUMULATING candidates with enough stored dates become READY_FOR_BACKTEST."""
    full = (
        rs.groupBy("ticker", "parent")
        .agg(F.count_distinct("date").alias("_d"))
        .filter(F.col("_d") >= days)
        .select("ticker", "parent", F.lit(True).alias("_full"))
    )
    ready = F.col("_full") & (F.col("status") == "ACCUMULATING")
    return (
        candidates.join(full, ["ticker", "parent"], "left")
        .withColumn("status", F.when(ready, "READY_FOR_BACKTEST").otherwise(F.col("status")))
        .select(*candidates.columns)
    )


def decide(candidates: DataFrame, ics: DataFrame) -> DataFrame:
    """READY candidates become PROMOTED or FAILED by their pair ICs; the rest stay.

    A ready pair without any IC row fails.
    """
    rows = candidates.join(ics.select("ticker", "parent", "passed"), ["ticker", "parent"], "left")
    verdict = F.when(F.coalesce("passed", F.lit(False)), "PROMOTED").otherwise("FAILED")
    return rows.withColumn(
        "status", F.when(F.col("status") == "READY_FOR_BACKTEST", verdict).otherwise(F.col("status"))
    ).select(*candidates.columns)


def backtest_results(candidates: DataFrame, ics: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Result table with one row per READY candidate for the run date."""
    ready = candidates.filter(F.col("status") == "READY_FOR_BACKTEST").select("ticker", "parent")
    rows = ready.join(ics.select("ticker", "parent", "ic_h1", "ic_h2", "ic_full", "passed"), ["ticker", "parent"], "left").select(
        "ticker", "parent", F.lit(as_of).cast("date").alias("run_date"), "ic_h1", "ic_h2", "ic_full",
        F.coalesce("passed", F.lit(False)).alias("passed"),
    )
    return upsert(results, rows, ["ticker", "parent", "run_date"])


def promoted_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges of the candidates promoted by this run, with the starting weight."""
    ready = before.filter(F.col("status") == "READY_FOR_BACKTEST").select("ticker", "parent")
    return (
        after.filter(F.col("status") == "PROMOTED")
        .join(ready, ["ticker", "parent"], "left_semi")
        .select("parent", F.col("ticker").alias("child"), F.lit("systems").alias("edge_type"), F.lit(PROMOTED_WEIGHT).alias("weight"))
    )


# ---- panel --------------------------------------------------------------------------


def candidate_progress(candidates: DataFrame, rs: DataFrame, status: str = "ACCUMULATING") -> DataFrame:
    """Stored days and mean strength per candidate; candidates without history keep 0 days."""
    return (
        candidates.filter(F.col("status") == status)
        .join(rs.select("ticker", "parent", "date", "rs_score"), ["ticker", "parent"], "left")
        .groupBy("ticker", "parent", "dependency_strength")
        .agg(F.count_distinct("date").alias("days"), F.avg("rs_score").alias("mean_rs"))
    )


def accum_trend(rs: DataFrame, band: float = 0.002) -> DataFrame:
    """Arrow per pair: mean of the newest five scores against the five before.

    The earlier scores are those of the newest ten whose *value* is not among the newest five.
    """
    newest = top_n(rs.select("ticker", "parent", "date", "rs_score"), ["ticker", "parent"], [F.desc("date")], 10)
    lists = newest.groupBy("ticker", "parent").agg(
        F.collect_list(F.when(F.col("rn") <= 5, F.col("rs_score"))).alias("_new"), F.collect_list("rs_score").alias("_ten")
    )
    mean = lambda a: F.aggregate(F.array_sort(a), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))
    last5 = mean(F.col("_new"))
    prior5 = mean(F.filter("_ten", lambda v: ~F.array_contains(F.col("_new"), v)))
    trend = (
        F.when(last5.isNull() | prior5.isNull(), "→").when(last5 > prior5 + band, "↑").when(last5 < prior5 - band, "↓").otherwise("→")
    )
    return lists.select("ticker", "parent", last5.alias("last5"), prior5.alias("prior5"), trend.alias("trend"))


def results_by_status(results: DataFrame, candidates: DataFrame, status: str, since) -> DataFrame:
    """Backtest results of candidates in a status, run on or after ``since``."""
    named = candidates.filter(F.col("status") == status).select("ticker", "parent")
    return results.join(named, ["ticker", "parent"]).filter(F.col("run_date") >= F.lit(since).cast("date"))


def discovery_panel(candidates: DataFrame, rs: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """All sections of the overview in one frame: section, ticker, parent, days, value, trend.

    value is the mean strength (accumulating), the first-half IC (promoted, failed)
    or NULL. Results reach back 30 days, new candidates 7.
    """
    day = F.lit(as_of).cast("date")
    none = F.lit(None)
    acc = candidate_progress(candidates, rs).join(accum_trend(rs).select("ticker", "parent", "trend"), ["ticker", "parent"], "left")
    section = lambda df, name, days, value, trend: df.select(
        F.lit(name).alias("section"), "ticker", "parent", days.cast("long").alias("days"), value.cast("double").alias("value"), trend.cast("string").alias("trend")
    )
    out = section(acc, "accumulating", F.col("days"), F.col("mean_rs"), F.coalesce("trend", F.lit("→")))
    out = out.unionByName(section(candidate_progress(candidates, rs, "READY_FOR_BACKTEST"), "ready", F.col("days"), none, none))
    for status in ("PROMOTED", "FAILED"):
        hits = results_by_status(results, candidates, status, "1900-01-01").filter(F.col("run_date") >= F.date_sub(day, 30))
        out = out.unionByName(section(hits, status.lower(), none, F.col("ic_h1"), none))
    fresh = candidates.filter(F.col("discovered_date") >= F.date_sub(day, 7))
    return out.unionByName(section(fresh, "new", none, none, none))
