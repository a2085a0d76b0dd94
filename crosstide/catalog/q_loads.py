"""Queries over sources, merge semantics, parsing and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crosstide.catalog import inputs as inp
from crosstide.catalog import q_features, q_signals  # noqa: F401  (define shared SQL parts)
from crosstide.catalog.registry import query, r8
from crosstide.catalog.sqlparts import part, r8s, with_parts
from crosstide.functions import text as tx
from crosstide.sources import filings as fl
from crosstide.sources import form4 as f4
from crosstide.session import checkpoint_dir
from crosstide.sources import tables as tb
from crosstide.sources.bars import bars_from_json


def day(s: str):
    return F.lit(s).cast("date")


# ---- bars ---------------------------------------------------------------------------


@query("bars_from_vendor_json", "S-01b X-12 X-09", with_parts("SELECT ticker, date, close, volume, close AS adj_close FROM bars", "bars"))
def _(spark, d):
    b = inp.bars(spark, d)
    bar = F.struct(
        (F.unix_date("date").cast("long") * 86_400_000).alias("t"),
        F.col("open").alias("o"),
        F.col("high").alias("h"),
        F.col("low").alias("l"),
        F.col("close").alias("c"),
        F.col("volume").cast("double").alias("v"),
    )
    landed = b.select("ticker", F.to_json(F.struct(F.array(bar).alias("results"))).alias("body"))
    return bars_from_json(landed).select("ticker", "date", "close", "volume", "adj_close")


@query(
    "bars_of_window",
    "P-01 P-02 P-03",
    with_parts("SELECT ticker, date, close FROM bars WHERE date > DATE '1997-06-30' AND date <= DATE '1997-12-31' AND ticker IN ('NATION_1', 'NATION_7', 'NATION_12') AND volume >= 10", "bars"),
)
def _(spark, d):
    conditions = [
        F.col("date") > day("1997-06-30"),
        F.col("date") <= day("1997-12-31"),
        F.col("ticker").isin("NATION_1", "NATION_7", "NATION_12"),
        F.col("volume") >= 10,
    ]
    out = inp.bars(spark, d)
    for c in conditions:
        out = out.filter(c)
    return out.select("ticker", "date", "close")


@query("rows_per_date", "A-09", with_parts("SELECT date, count(*) AS n FROM bars GROUP BY 1 ORDER BY 1 DESC LIMIT 3", "bars"))
def _(spark, d):
    return inp.bars(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("date")).limit(3)


# ---- merge semantics ----------------------------------------------------------------


@query(
    "upsert_bars",
    "S-02",
    with_parts(
        """SELECT ticker, date, close, volume FROM bars WHERE date < DATE '1998-01-01'
UNION ALL SELECT ticker, date, close, volume + 2 FROM bars WHERE date >= DATE '1998-01-01'""",
        "bars",
    ),
)
def _(spark, d):
    b = inp.bars(spark, d).select("ticker", "date", "close", "volume")
    target = b.filter(F.col("date") < day("1999-01-01"))
    late = b.filter(F.col("date") >= day("1998-01-01"))
    batch = late.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("volume", F.col("volume") + F.col("seq"))
    return tb.upsert(target, batch, ["ticker", "date"], ["seq"]).select("ticker", "date", "close", "volume")


@query(
    "upserted_store",
    "S-02",
    with_parts(
        """SELECT ticker, date, close, volume FROM bars WHERE date < DATE '1998-01-01'
UNION ALL SELECT ticker, date, close, volume + 2 FROM bars WHERE date >= DATE '1998-01-01'""",
        "bars",
    ),
)
def _(spark, d):
    """The upsert of ``upsert_bars`` on a table stored by month, read back."""
    path = f"{checkpoint_dir(spark)}/bars-{uuid.uuid4().hex}"
    b = inp.bars(spark, d).select("ticker", "date", "close", "volume").withColumn("month", F.date_format("date", "yyyyMM").cast("int"))
    tb.upsert_stored(spark, path, b.filter(F.col("date") < day("1999-01-01")), ["ticker", "date"], ["month"])
    late = b.filter(F.col("date") >= day("1998-01-01"))
    batch = late.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("volume", F.col("volume") + F.col("seq"))
    tb.upsert_stored(spark, path, batch, ["ticker", "date"], ["month"], ["seq"])
    return spark.read.parquet(path).select("ticker", "date", "close", "volume")


@query(
    "insert_new_bars",
    "S-03 J-10",
    with_parts(
        """SELECT ticker, date, close, volume FROM bars WHERE date < DATE '1999-01-01'
UNION ALL SELECT ticker, date, close, volume + 1 FROM bars WHERE date >= DATE '1999-01-01'""",
        "bars",
    ),
)
def _(spark, d):
    b = inp.bars(spark, d).select("ticker", "date", "close", "volume")
    target = b.filter(F.col("date") < day("1999-01-01"))
    late = b.filter(F.col("date") >= day("1998-01-01"))
    batch = late.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("volume", F.col("volume") + F.col("seq"))
    return tb.insert_ignore(target, batch, ["ticker", "date"], ["seq"]).select("ticker", "date", "close", "volume")


@query(
    "replace_bar_dates",
    "S-04",
    with_parts(
        """SELECT ticker, date, close, volume FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bars n WHERE n.date = b.date AND n.ticker = 'NATION_2')
UNION ALL SELECT ticker, date, close, 0 FROM bars WHERE ticker = 'NATION_2'""",
        "bars",
    ),
)
def _(spark, d):
    b = inp.bars(spark, d).select("ticker", "date", "close", "volume")
    batch = b.filter(F.col("ticker") == "NATION_2").withColumn("volume", F.lit(0).cast("long"))
    return tb.replace_partition(b, batch, ["date"])


@query(
    "synced_edges",
    "S-06",
    with_parts(
        """SELECT ticker, parent, source FROM (SELECT child AS ticker, parent, 'discovery_promoted' AS source FROM edges WHERE weight >= 0.8::DOUBLE
UNION ALL SELECT child, parent, 'static' FROM edges WHERE NOT weight >= 0.8::DOUBLE)""",
        "edges",
    ),
)
def _(spark, d):
    from crosstide.plans.discovery import sync_edges

    e = inp.edges(spark, d)
    graph = e.filter(F.col("weight") >= 0.8).select(
        F.col("child").alias("ticker"), "parent", F.lit("discovery_promoted").alias("source"), F.lit("ACTIVE").alias("status")
    )
    return sync_edges(graph, e, "2000-01-01").select("ticker", "parent", "source")


@query(
    "ingest_windows",
    "S-08",
    with_parts(
        """SELECT t.ticker, CASE WHEN b.ticker IS NULL THEN DATE '2000-01-01' - 730 ELSE DATE '2000-01-01' - 30 END AS start, DATE '2000-01-01' AS "end",
 CASE WHEN b.ticker IS NULL THEN 'full' ELSE 'incremental' END AS mode
FROM (SELECT ticker FROM themes UNION SELECT benchmark FROM themes) t LEFT JOIN (SELECT DISTINCT ticker FROM bars) b USING (ticker)""",
        "themes",
        "bars",
    ),
)
def _(spark, d):
    th = inp.themes(spark, d)
    names = th.select("ticker").union(th.select("benchmark")).distinct()
    return tb.ingest_windows(names, inp.bars(spark, d), "2000-01-01")


@query(
    "ingest_status",
    "S-09",
    with_parts(
        """SELECT t.ticker, CASE WHEN t.ticker = 'NATION_4' THEN 0 ELSE coalesce(n, 0) END AS rows_written,
 CASE WHEN t.ticker = 'NATION_4' THEN 'error' WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, CASE WHEN t.ticker = 'NATION_4' THEN 'timeout' END AS error_msg
FROM (SELECT ticker FROM themes UNION SELECT benchmark FROM themes) t LEFT JOIN (SELECT ticker, count(*) AS n FROM bars WHERE date >= DATE '1998-01-01' GROUP BY 1) b USING (ticker)""",
        "themes",
        "bars",
    ),
)
def _(spark, d):
    th = inp.themes(spark, d)
    names = th.select("ticker").union(th.select("benchmark")).distinct()
    errors = names.filter(F.col("ticker") == "NATION_4").withColumn("error_msg", F.lit("timeout"))
    return tb.ingest_status(names, inp.bars(spark, d).filter(F.col("date") >= day("1998-01-01")), errors)


@query(
    "next_events",
    "S-15 G-19",
    with_parts(
        """SELECT ticker, next_event_date, days, CASE WHEN days > 14 THEN '' WHEN days = 0 THEN 'EARNINGS TODAY' WHEN days <= 2 THEN 'EARNINGS TOMORROW' ELSE 'EARNINGS ' || days || 'd' END AS flag,
 CASE WHEN days > 14 THEN '' WHEN days <= 2 THEN 'red' WHEN days <= 7 THEN 'orange' ELSE 'yellow' END AS severity
FROM (SELECT ticker, min(transaction_date) AS next_event_date, min(transaction_date) - DATE '1998-06-30' AS days FROM trades WHERE transaction_date >= DATE '1998-06-30' AND is_officer AND total_value > 350000 GROUP BY 1)""",
        "trades",
    ),
)
def _(spark, d):
    from crosstide.plans.scan import event_proximity

    events = inp.trades(spark, d).filter(F.col("is_officer") & (F.col("total_value") > 350000)).select(
        "ticker", F.col("transaction_date").alias("date")
    )
    return event_proximity(tb.next_event(events, "1998-06-30"), "1998-06-30").withColumn("days", F.col("days").cast("long"))


@query(
    "identifier_map",
    "S-13 X-07",
    "SELECT upper(n_name) AS ticker, lpad(CAST(n_nationkey * 1234567 AS VARCHAR), 10, '0') AS cik FROM nation",
)
def _(spark, d):
    n = inp.table(spark, d, "nation")
    listing = n.select(
        F.lower("n_name").alias("ticker"), (F.col("n_nationkey") * 1234567).alias("cik_str"), F.col("n_nationkey").alias("position")
    )
    return tb.cik_map(listing)


@query(
    "revision_scores",
    "S-14 X-10",
    with_parts(
        f"SELECT ticker, date, analysts_up, analysts_down, {r8s('(analysts_up - analysts_down) / nullif(analysts_up + analysts_down, 0)')} AS revision_score FROM estimates",
        "estimates",
    ),
)
def _(spark, d):
    s = tb.revision_score(inp.estimates(spark, d))
    return s.select("ticker", "date", "analysts_up", "analysts_down", r8("revision_score").alias("revision_score"))


# ---- short interest and news --------------------------------------------------------

part(
    "short",
    """
SELECT ticker, date_trunc('month', transaction_date)::DATE AS settlement_date, count(*) AS short_interest, count(*) / 4.0::DOUBLE AS days_to_cover,
  (count(*) * 10 % 17)::DOUBLE AS short_percent_of_float FROM trades GROUP BY 1, 2""",
    "trades",
)


def short(spark, d):
    t = inp.trades(spark, d)
    raw = t.groupBy("ticker", F.trunc("transaction_date", "month").alias("m")).agg(F.count(F.lit(1)).alias("short_interest"))
    return raw.select(
        "ticker",
        F.concat(F.date_format("m", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("settlement_date"),
        "short_interest",
        (F.col("short_interest") / 4.0).alias("days_to_cover"),
        (F.col("short_interest") * 10 % 17).alias("short_percent_of_float"),
    )


@query("short_interest_rows", "S-18 X-08 P-05", with_parts("SELECT * FROM short", "short"))
def _(spark, d):
    return tb.load_short(short(spark, d))


@query(
    "short_interest_latest",
    "G-31 J-12",
    with_parts(
        "SELECT ticker, settlement_date, short_percent_of_float, short_percent_of_float >= 10 AS is_high FROM short QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY settlement_date DESC) = 1",
        "short",
    ),
)
def _(spark, d):
    from crosstide.plans.scan import short_interest_latest

    return short_interest_latest(tb.load_short(short(spark, d)))


part(
    "news",
    """
SELECT 'NATION_' || doc_id % 25 AS ticker, DATE '2024-01-01' + CAST(doc_id * 7 % 28 AS INTEGER) AS published_date, source || ' report ' || lang || ' ' || n_chars % 3 AS title,
  CASE WHEN n_chars % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment, 'u' || doc_id AS article_url, doc_id FROM documents""",
)


def news(spark, d):
    doc = inp.table(spark, d, "documents")
    when = F.date_add(day("2024-01-01"), (F.col("doc_id") * 7 % 28).cast("int"))
    raw = doc.select(
        F.concat(F.lit("NATION_"), F.col("doc_id") % 25).alias("ticker"),
        F.concat(F.date_format(when, "yyyy-MM-dd"), F.lit("T12:00:00Z")).alias("published_utc"),
        F.concat(F.lit("  "), F.concat_ws(" ", "source", F.lit("report"), "lang", F.col("n_chars") % 3), F.lit(" ")).alias("title"),
        F.when(F.col("n_chars") % 2 == 0, "positive").otherwise("negative").alias("sentiment"),
        F.concat(F.lit("u"), "doc_id").alias("article_url"),
        "doc_id",
    )
    return tb.load_news(raw), raw


@query(
    "news_rows",
    "S-18 S-03",
    with_parts(
        """SELECT ticker, published_date, title, CASE WHEN count(*) FILTER (article_url LIKE '%3') > 0 THEN 'stored' ELSE arg_min(sentiment, article_url) END AS sentiment,
  coalesce(min(article_url) FILTER (article_url LIKE '%3'), min(article_url)) AS article_url FROM news GROUP BY 1, 2, 3""",
        "news",
    ),
)
def _(spark, d):
    rows, _raw = news(spark, d)
    return tb.insert_ignore(stored_news(rows), rows, ["ticker", "published_date", "title"], ["article_url"])


def stored_news(rows):
    """Rows that an earlier load has left, with an own sentiment: a later load must not replace them."""
    old = rows.filter("article_url LIKE '%3'").groupBy("ticker", "published_date", "title").agg(F.min("article_url").alias("article_url"))
    return old.withColumn("sentiment", F.lit("stored")).select(*rows.columns)


@query(
    "news_feed",
    "G-30 W-14",
    with_parts(
        """SELECT ticker, published_date, title, rn FROM (SELECT ticker, published_date, title, row_number() OVER (PARTITION BY ticker ORDER BY published_date DESC, title) AS rn
FROM (SELECT DISTINCT ticker, published_date, title FROM news) WHERE published_date >= DATE '2024-01-28' - 7) WHERE rn <= 5""",
        "news",
    ),
)
def _(spark, d):
    from crosstide.plans.scan import news_feed

    rows, _raw = news(spark, d)
    stored = tb.insert_ignore(stored_news(rows), rows, ["ticker", "published_date", "title"], ["article_url"])
    return news_feed(stored, "2024-01-28").select("ticker", "published_date", "title", "rn")


@query(
    "deduped_headlines",
    "T-10",
    with_parts("SELECT lower(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY 1"),
)
def _(spark, d):
    from crosstide.plans.scan import dedupe_text

    doc = inp.table(spark, d, "documents")
    return dedupe_text(doc, "text", ["doc_id"]).select(F.lower("text").alias("text_key"), "doc_id")


# ---- journal sheet ------------------------------------------------------------------


@query(
    "journal_migration",
    "S-19 X-08",
    with_parts(
        f"""SELECT transaction_date AS scan_date, ticker, insider_title AS parent, CASE WHEN old THEN -1.0 ELSE total_value END AS price, CAST(rs AS DOUBLE) AS rs_score, CASE WHEN ok THEN CAST(rs % 40 AS INTEGER) END AS earnings_days
FROM (SELECT *, CAST(accession_number AS BIGINT) % 97 AS rs, CAST(accession_number AS BIGINT) % 3 <> 0 AS ok, CAST(accession_number AS BIGINT) % 5 = 0 AS old FROM trades)
QUALIFY row_number() OVER (PARTITION BY transaction_date, ticker, insider_title ORDER BY old DESC, CAST(accession_number AS BIGINT)) = 1""",
        "trades",
    ),
)
def _(spark, d):
    merged, _counts = tb.migrate_journal(journal_sheet(spark, d), stored_journal(spark, d), ["position"])
    return merged.select("scan_date", "ticker", "parent", "price", "rs_score", "earnings_days")


def journal_sheet(spark, d):
    t = inp.trades(spark, d)
    n = F.col("accession_number").cast("long")
    none = F.lit("")
    return t.select(
        F.date_format("transaction_date", "yyyy-MM-dd").alias("scan_date"),
        F.concat(F.lit(" "), "ticker").alias("ticker"),
        F.col("insider_title").alias("parent"),
        none.alias("parent_regime"),
        F.concat(F.lit("$"), F.format_number("total_value", 2)).alias("price"),
        F.concat(F.lit("+"), n % 97).alias("rs_score"),
        none.alias("rank"),
        none.alias("action_label"),
        none.alias("insider_annotation"),
        F.when(n % 3 != 0, (n % 97 % 40).cast("string")).otherwise("n/a").alias("earnings_days"),
        none.alias("parent_20d_return"),
        none.alias("notes"),
        n.alias("position"),
    )


def stored_journal(spark, d):
    """Rows that an earlier migration has left, with an own price."""
    old = tb.parse_journal(journal_sheet(spark, d), ["position"]).filter("position % 5 = 0")
    first = old.groupBy("scan_date", "ticker", "parent").agg(F.min_by(F.struct(*old.columns), "position").alias("r")).select("r.*")
    return first.withColumn("price", F.lit(-1.0)).drop("position")


@query(
    "journal_migration_counts",
    "S-19",
    with_parts(
        """WITH k AS (SELECT count(*) AS n, count(*) FILTER (CAST(accession_number AS BIGINT) % 5 = 0) AS old FROM trades GROUP BY transaction_date, ticker, insider_title)
SELECT count(*) FILTER (old = 0) AS inserted, CAST(sum(n) - count(*) FILTER (old = 0) AS BIGINT) AS skipped FROM k""",
        "trades",
    ),
)
def _(spark, d):
    return tb.migrate_journal(journal_sheet(spark, d), stored_journal(spark, d), ["position"])[1]


# ---- retention ----------------------------------------------------------------------

part(
    "stored_filings",
    """
SELECT CAST(accession_number AS BIGINT) AS id, ticker, filed_date, accession_number, CASE insider_title WHEN 'BUILDING' THEN 'HIGH' WHEN 'MACHINERY' THEN 'MEDIUM' ELSE 'LOW' END AS impact,
  is_director AS saved_to_journal, CASE WHEN is_officer THEN 'text' END AS summary FROM trades""",
    "trades",
)


def stored_filings(spark, d):
    return inp.trades(spark, d).select(
        F.col("accession_number").cast("long").alias("id"),
        "ticker",
        "filed_date",
        "accession_number",
        F.when(F.col("insider_title") == "BUILDING", "HIGH").when(F.col("insider_title") == "MACHINERY", "MEDIUM").otherwise("LOW").alias("impact"),
        F.col("is_director").alias("saved_to_journal"),
        F.when(F.col("is_officer"), "text").alias("summary"),
    )


_GONE = "NOT saved_to_journal AND filed_date < DATE '1998-06-30' - CASE impact WHEN 'LOW' THEN 30 WHEN 'MEDIUM' THEN 90 ELSE 365 END"


@query("retained_filings", "S-21", with_parts(f"SELECT id, ticker, filed_date, impact FROM stored_filings WHERE NOT ({_GONE})", "stored_filings"))
def _(spark, d):
    return tb.retain_filings(stored_filings(spark, d), "1998-06-30").select("id", "ticker", "filed_date", "impact")


@query(
    "retention_counts",
    "S-21",
    with_parts(
        f"""SELECT count(*) FILTER ({_GONE} AND impact = 'LOW') AS low_removed, count(*) FILTER ({_GONE} AND impact = 'MEDIUM') AS medium_removed,
 count(*) FILTER ({_GONE} AND impact = 'HIGH') AS high_removed, count(*) FILTER (saved_to_journal) AS protected FROM stored_filings""",
        "stored_filings",
    ),
)
def _(spark, d):
    return tb.retention_counts(stored_filings(spark, d), "1998-06-30")


@query(
    "pruned_rows",
    "S-22",
    with_parts("SELECT id FROM stored_filings WHERE filed_date >= DATE '2000-01-01' - 30 AND NOT (impact = 'HIGH' AND summary IS NULL)", "stored_filings"),
)
def _(spark, d):
    f = tb.prune_older(stored_filings(spark, d), "filed_date", "2000-01-01")
    return tb.purge_without_summary(f).select("id")


@query("newest_audit_rows", "S-22 T-09", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS run_date FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def _(spark, d):
    o = inp.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("run_date"))
    return tb.keep_newest(o, ["run_date", "id"], 200)


@query("recent_scan_dates", "T-09", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS scan_date FROM orders ORDER BY 1 DESC")
def _(spark, d):
    return inp.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("scan_date")).distinct().orderBy(F.desc("scan_date"))


@query(
    "filing_summary_flags",
    "P-04 P-05",
    with_parts(
        "SELECT id, summary IS NOT NULL AS has_summary, coalesce(summary, '') AS summary, length(accession_number) AS len FROM stored_filings",
        "stored_filings",
    ),
)
def _(spark, d):
    return stored_filings(spark, d).select(
        "id",
        F.col("summary").isNotNull().alias("has_summary"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.length("accession_number").cast("long").alias("len"),
    )


# ---- filings ------------------------------------------------------------------------

part(
    "landed_filings",
    """
SELECT ticker, accession_number, filed_date,
  CASE transaction_code WHEN 'P' THEN [' 2.02 ', '9.01'] WHEN 'S' THEN ['7.01', '5.02'] ELSE CASE WHEN is_officer THEN ['5.02'] ELSE ['9.01'] END END AS items,
  insider_name || CASE insider_title WHEN 'BUILDING' THEN ' announced an acquisition for $' WHEN 'MACHINERY' THEN ' filed an amendment worth $' WHEN 'HOUSEHOLD' THEN ' reports $' ELSE ' corrected an exhibit, CEO to resign, $' END
   || CAST(floor(total_value / 100) AS BIGINT) || CASE WHEN is_director THEN '.5' || chr(160) || 'Million today.' ELSE ' M today.' END AS text
FROM trades""",
    "trades",
)
part(
    "impacts",
    f"""
SELECT ticker, filed_date, accession_number, array_to_string(mat, ',') AS item_numbers, CASE final WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS impact
FROM (SELECT *, CASE WHEN boost AND NOT down THEN least(rk + 1, 2) WHEN down AND NOT boost THEN greatest(rk - 1, 0) ELSE rk END AS final
 FROM (SELECT *, greatest(CASE WHEN list_has_any(mat, ['2.02', '1.01', '2.01']) THEN 2 WHEN list_has_any(mat, ['7.01', '8.01', '1.02', '2.05']) THEN 1 ELSE 0 END,
    CASE WHEN mil >= 1000 THEN 2 WHEN mil >= 100 THEN 1 ELSE 0 END) AS rk,
   {' OR '.join(f"contains(body, '{w}')" for w in tx.BOOST_KEYWORDS)} AS boost, {' OR '.join(f"contains(body, '{w}')" for w in tx.DOWNGRADE_KEYWORDS)} AS down
  FROM (SELECT *, lower(text) AS body, list_filter(list_transform(items, lambda x: trim(x)), lambda x: x IN ({', '.join(f"'{c}'" for c in tx.MATERIAL_ITEMS)})) AS mat,
    list_max(list_transform(regexp_extract_all(lower(text), '\\$[\\s\\x{{A0}}]*([\\d,]+(?:\\.\\d+)?)[\\s\\x{{A0}}]*(billion|million|b|m)\\b', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))) AS mil FROM landed_filings)))
WHERE len(mat) > 0""",
    "landed_filings",
)


def landed_filings(spark, d):
    t = inp.trades(spark, d)
    seg, code = F.col("insider_title"), F.col("transaction_code")
    lit_array = lambda *v: F.array(*[F.lit(x) for x in v])
    return t.select(
        "ticker",
        "accession_number",
        F.concat(F.date_format("filed_date", "yyyy-MM-dd"), F.lit("T09:30:00Z")).alias("filed_at"),
        F.when(code == "P", lit_array(" 2.02 ", "9.01"))
        .when(code == "S", lit_array("7.01", "5.02"))
        .when(F.col("is_officer"), lit_array("5.02"))
        .otherwise(lit_array("9.01"))
        .alias("items"),
        F.concat(
            "insider_name",
            F.when(seg == "BUILDING", " announced an acquisition for $")
            .when(seg == "MACHINERY", " filed an amendment worth $")
            .when(seg == "HOUSEHOLD", " reports $")
            .otherwise(" corrected an exhibit, CEO to resign, $"),
            F.floor(F.col("total_value") / 100).cast("string"),
            F.when(F.col("is_director"), ".5 Million today.").otherwise(" M today."),
        ).alias("text"),
        F.lit("S-3").alias("form_type"),
    )


@query(
    "filing_impacts",
    "X-02 X-03 S-16",
    with_parts("SELECT * FROM impacts WHERE filed_date >= DATE '1996-01-01' AND ticker <> 'NATION_3'", "impacts"),
)
def _(spark, d):
    rows = fl.event_filings(landed_filings(spark, d), "1996-01-01", foreign=("NATION_3",))
    return rows.select("ticker", "filed_date", "accession_number", "item_numbers", "impact")


@query(
    "loaded_filings",
    "S-16 J-10",
    with_parts(
        """SELECT accession_number, impact, row_number() OVER (ORDER BY ticker, accession_number) + (SELECT coalesce(max(id), 0) FROM stored_filings WHERE filed_date < DATE '1997-01-01') AS id
FROM impacts WHERE filed_date >= DATE '1996-01-01' AND ticker <> 'NATION_3' AND accession_number NOT IN (SELECT accession_number FROM stored_filings WHERE filed_date < DATE '1997-01-01')""",
        "impacts",
        "stored_filings",
    ),
)
def _(spark, d):
    batch = fl.event_filings(landed_filings(spark, d), "1996-01-01", foreign=("NATION_3",))
    existing = stored_filings(spark, d).filter(F.col("filed_date") < day("1997-01-01"))
    return fl.load_filings(batch, existing).select("accession_number", "impact", "id")


@query(
    "shelf_registrations",
    "S-17",
    with_parts(
        """SELECT ticker, filed_date, accession_number, 'HIGH' AS impact, 'NEGATIVE' AS sentiment,
 ticker || ' filed Form S-3 shelf registration. This signals potential upcoming capital raise which may be dilutive to existing shareholders.' AS summary
FROM landed_filings WHERE filed_date >= DATE '1996-01-01' AND ticker <> 'NATION_3'""",
        "landed_filings",
    ),
)
def _(spark, d):
    s = fl.shelf_filings(landed_filings(spark, d), "1996-01-01", foreign=("NATION_3",))
    return s.select("ticker", "filed_date", "accession_number", "impact", "sentiment", "summary")


# ---- ownership documents ------------------------------------------------------------


def form4_documents(spark, d):
    """One ownership document per order with a purchase, a sale and an award."""
    t = inp.spread(inp.trades(spark, d), "accession_number")
    note = (
        F.when(F.col("insider_title") == "BUILDING", "Bought in the underwritten offering.")
        .when(F.col("insider_title") == "MACHINERY", "See the registration statement on Form S-3.")
        .otherwise("Held directly.")
    )
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    trade = lambda code, foot, shares: F.concat(
        F.lit("<nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>"),
        F.date_format("transaction_date", "yyyy-MM-dd"),
        F.lit(f"</value></transactionDate><transactionCoding><transactionFormType>4</transactionFormType><transactionCode>{code}</transactionCode></transactionCoding>"),
        F.lit("<transactionAmounts><transactionShares><value>"),
        shares,
        F.lit("</value></transactionShares><transactionPricePerShare><value>"),
        F.col("total_value").cast("decimal(18,2)").cast("string"),
        F.lit("</value></transactionPricePerShare></transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>500</value>"),
        F.lit("</sharesOwnedFollowingTransaction></postTransactionAmounts><ownershipNature><natureOfOwnership><value>D</value>"),
        F.lit(f'<footnoteId id="{foot}"/>'),
        F.lit("</natureOfOwnership></ownershipNature></nonDerivativeTransaction>"),
    )
    xml = F.concat(
        F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>"),
        "insider_name",
        F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>"),
        flag("is_director"),
        F.lit("</isDirector><isOfficer>"),
        flag("is_officer"),
        F.lit("</isOfficer><officerTitle>"),
        "insider_title",
        F.lit("</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"),
        trade("A", "F2", F.lit("5")),
        trade("P", "F1", F.lit("10")),
        trade("S", "F2", F.lit("20")),
        F.lit("</nonDerivativeTable><footnotes><footnote id=\"F1\">"),
        note,
        F.lit("</footnote><footnote id=\"F2\">None.</footnote></footnotes></ownershipDocument>"),
    )
    broken = F.col("transaction_code") == "A"
    return t.select(
        "accession_number",
        "ticker",
        "filed_date",
        F.concat(F.lit("https://filings.example/"), "accession_number").alias("filing_url"),
        F.when(broken, F.substring(xml, 1, 120)).otherwise(xml).alias("xml"),
    )


@query(
    "form4_trades",
    "S-10 X-01",
    with_parts(
        """SELECT accession_number, 1 AS transaction_seq, 'P' AS transaction_code, transaction_date, insider_name, is_officer, is_director, 10 * total_value AS total_value,
 insider_title <> 'BUILDING' AS is_open_market, CASE WHEN insider_title = 'BUILDING' THEN 'Bought in the underwritten offering.' ELSE 'Held directly.' END AS footnote_text
FROM trades WHERE transaction_code <> 'A' AND insider_title <> 'MACHINERY'
UNION ALL SELECT accession_number, 2, 'S', transaction_date, insider_name, is_officer, is_director, 20 * total_value, NULL, 'None.' FROM trades WHERE transaction_code <> 'A'""",
        "trades",
    ),
)
def _(spark, d):
    trades, _review = f4.parse_form4(form4_documents(spark, d))
    return trades.select(
        "accession_number", "transaction_seq", "transaction_code", "transaction_date", "insider_name", "is_officer", "is_director", "total_value", "is_open_market", "footnote_text"
    )


@query(
    "form4_review_rows",
    "S-10",
    with_parts(
        "SELECT accession_number, 1 AS transaction_seq, 'prospectus_reference' AS reason FROM trades WHERE transaction_code <> 'A' AND insider_title = 'MACHINERY'",
        "trades",
    ),
)
def _(spark, d):
    return f4.parse_form4(form4_documents(spark, d))[1].select("accession_number", "transaction_seq", "reason")


part(
    "listing",
    """
SELECT ticker || '/' || transaction_date AS accession_number, CAST(accession_number AS BIGINT) AS position, transaction_code, total_value,
  CASE WHEN is_director THEN 'holding' ELSE 'transaction' END AS record_type, CASE WHEN insider_title = 'FURNITURE' THEN 'derivative' ELSE 'non_derivative' END AS security_type FROM trades""",
    "trades",
)


def listing(spark, d):
    return inp.trades(spark, d).select(
        F.concat_ws("/", "ticker", "transaction_date").alias("accession_number"),
        F.col("accession_number").cast("long").alias("position"),
        "transaction_code",
        "total_value",
        F.when(F.col("is_director"), "holding").otherwise("transaction").alias("record_type"),
        F.when(F.col("insider_title") == "FURNITURE", "derivative").otherwise("non_derivative").alias("security_type"),
    )


@query(
    "form4_sale_only_rows",
    "S-11",
    with_parts(
        """WITH ok AS (SELECT * FROM listing WHERE record_type = 'transaction' AND security_type = 'non_derivative' AND transaction_code IN ('P', 'S'))
SELECT accession_number, position, total_value, CAST(row_number() OVER (PARTITION BY accession_number ORDER BY position) - 1 AS INTEGER) AS transaction_seq
FROM ok WHERE accession_number NOT IN (SELECT accession_number FROM ok WHERE transaction_code = 'P')""",
        "listing",
    ),
)
def _(spark, d):
    return f4.form4_listing(listing(spark, d))[1].select("accession_number", "position", "total_value", "transaction_seq")


@query(
    "form4_filings_with_purchase",
    "S-11",
    with_parts(
        "SELECT DISTINCT accession_number FROM listing WHERE record_type = 'transaction' AND security_type = 'non_derivative' AND transaction_code = 'P'",
        "listing",
    ),
)
def _(spark, d):
    return f4.form4_listing(listing(spark, d))[0]


@query(
    "form4_array_listing",
    "S-12 X-11",
    with_parts(
        """SELECT ticker, accession_number || '-' || k AS accession_number, CAST(transaction_date + k AS VARCHAR) AS filing_date, doc AS primary_document
FROM trades, (VALUES (0, 'a.xml'), (1, 'xsl/b.xml')) v(k, doc) WHERE transaction_date + k >= DATE '1998-01-01'""",
        "trades",
    ),
)
def _(spark, d):
    t = inp.trades(spark, d)
    days = [F.date_format(F.date_add("transaction_date", k), "yyyy-MM-dd") for k in range(4)]
    names = [F.concat("accession_number", F.lit(f"-{k}")) for k in range(4)]
    batch = t.select(
        "ticker",
        F.array(*[F.lit(x) for x in ("4", "4/A", "8-K", "4")]).alias("form"),
        F.array(*days).alias("filingDate"),
        F.array(*names).alias("accessionNumber"),
        F.array(*[F.lit(x) for x in ("a.xml", "xsl/b.xml", "c.htm", "")]).alias("primaryDocument"),
    )
    return f4.filings_from_arrays(batch, "1998-01-01")


# ---- text helpers -------------------------------------------------------------------


@query(
    "document_paths",
    "X-05",
    "SELECT page_id, contains(lower(url), '/xsl') OR starts_with(lower(url), 'xsl') AS is_xsl, regexp_extract(url, '[^/]*$') AS name FROM pages",
)
def _(spark, d):
    p = inp.table(spark, d, "pages")
    return p.select("page_id", tx.is_xsl_path(F.col("url")).alias("is_xsl"), tx.strip_dir(F.col("url")).alias("name"))


@query(
    "redacted_urls",
    "X-04",
    "SELECT page_id, 'error at ' || url || '?apiKey=***' || '&page=' || page_id AS message FROM pages",
)
def _(spark, d):
    p = inp.table(spark, d, "pages")
    msg = F.concat(F.lit("error at "), "url", F.lit("?apiKey="), F.md5("url"), F.lit("&page="), "page_id")
    return p.select("page_id", tx.redact_key(msg).alias("message"))


@query(
    "offering_mentions",
    "X-01",
    "SELECT doc_id, "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in tx.OFFERING_KEYWORDS)
    + " AS offering, "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in tx.PROSPECTUS_PATTERNS)
    + " AS prospectus FROM documents",
)
def _(spark, d):
    doc = inp.table(spark, d, "documents")
    return doc.select(
        "doc_id", tx.offering_flag(F.col("text")).alias("offering"), tx.prospectus_flag(F.col("text")).alias("prospectus")
    )
