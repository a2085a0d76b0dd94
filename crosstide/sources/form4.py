"""Insider filings: ownership documents (XML), JSON listings and array listings to trade rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.text import offering_flag, parse_num, prospectus_flag

_DOCUMENT = (
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isOfficer:string,isDirector:string,isTenPercentOwner:string,officerTitle:string>>>,"
    "nonDerivativeTable struct<nonDerivativeTransaction:array<string>>,"
    "footnotes struct<footnote:array<struct<_id:string,_VALUE:string>>>"
)
_TRADE = (
    "transactionDate struct<value:string>,"
    "transactionCoding struct<transactionCode:string>,"
    "transactionAmounts struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>>,"
    "postTransactionAmounts struct<sharesOwnedFollowingTransaction:struct<value:string>>"
)
_FOOTNOTE_ID = r"<footnoteId\s+id\s*=\s*[\"']([^\"']+)[\"']"
_MAY_TRADE = r"[PS]\s*</(?i:transactionCode)"  # every purchase or sale has it, so other elements are not parsed
_BARE_LESS = r"<(?![/A-Za-z_:\x{80}-\x{10FFFF}])"


def _flag(c: Column) -> Column:
    return F.coalesce(F.trim(c).isin("1", "true", "True"), F.lit(False))


def _computed(df: DataFrame, keep: Column) -> DataFrame:
    """The rows where ``keep`` holds, all columns as results of an explode.

    Spark copies a plain filter, and later filters too, below the projections that
    compute their columns, and so parses and searches every row again for each mention.
    """
    return df.select(F.inline(F.when(keep, F.array(F.struct(*df.columns)))))


def explode_form4(filings: DataFrame) -> DataFrame:
    """One row per purchase or sale of the non-derivative table, footnotes resolved.

    ``filings`` has accession_number, ticker, filed_date, filing_url and xml. The
    sequence number counts every transaction element. Footnote ids are taken from
    anywhere inside the element. A malformed document gives no rows.
    """
    doc = filings.withColumn("_d", F.from_xml("xml", _DOCUMENT))
    owner = F.get("_d.reportingOwner", F.lit(0))
    filed = ["accession_number", "ticker", "filed_date", "filing_url"]
    doc = doc.select(
        *filed,
        F.trim(owner["reportingOwnerId"]["rptOwnerName"]).alias("insider_name"),
        F.trim(owner["reportingOwnerRelationship"]["officerTitle"]).alias("insider_title"),
        _flag(owner["reportingOwnerRelationship"]["isOfficer"]).alias("is_officer"),
        _flag(owner["reportingOwnerRelationship"]["isDirector"]).alias("is_director"),
        _flag(owner["reportingOwnerRelationship"]["isTenPercentOwner"]).alias("is_ten_percent_owner"),
        F.col("_d.footnotes.footnote").alias("_notes"),
        F.col("_d.nonDerivativeTable.nonDerivativeTransaction").alias("_all"),
    )
    # a missing table explodes to nothing; exploding the bare column would add a filter on it, which parses the document again
    rows = doc.select(*[c for c in doc.columns if c != "_all"], F.posexplode(F.coalesce("_all", F.array())).alias("transaction_seq", "_xml"))
    rows = rows.filter(F.col("_xml").rlike(_MAY_TRADE))
    # the element comes back as its inner text without escapes: put them back and wrap it to parse it as a document of its own
    inner = F.regexp_replace(F.replace(F.col("_xml"), F.lit("&"), F.lit("&amp;")), _BARE_LESS, "&lt;")
    wrapped = F.when(F.col("_xml").startswith("<nonDerivativeTransaction"), inner).otherwise(F.concat(F.lit("<t>"), inner, F.lit("</t>")))
    ids = F.regexp_extract_all("_xml", F.lit(_FOOTNOTE_ID), F.lit(1))
    note = lambda i: F.coalesce(
        F.get(F.transform(F.filter("_notes", lambda n: n["_id"] == i), lambda n: F.trim(n["_VALUE"])), F.lit(0)), F.lit("")
    )
    text = F.trim(F.array_join(F.transform(ids, note), " "))
    t = rows.withColumn("_t", F.from_xml(wrapped, _TRADE)).withColumn("footnote_text", F.nullif(text, F.lit("")))
    shares = parse_num(F.trim("_t.transactionAmounts.transactionShares.value"))
    price = parse_num(F.trim("_t.transactionAmounts.transactionPricePerShare.value"))
    t = t.select(
        "accession_number",
        "transaction_seq",
        "ticker",
        "filed_date",
        F.trim("_t.transactionDate.value").try_cast("date").alias("transaction_date"),
        "insider_name",
        "insider_title",
        "is_officer",
        "is_director",
        "is_ten_percent_owner",
        F.trim("_t.transactionCoding.transactionCode").alias("transaction_code"),
        shares.alias("shares"),
        price.alias("price_per_share"),
        (shares * price).alias("total_value"),
        parse_num(F.trim("_t.postTransactionAmounts.sharesOwnedFollowingTransaction.value")).alias("shares_owned_after"),
        "footnote_text",
        "filing_url",
    )
    return _computed(t, F.col("transaction_code").isin("P", "S"))


def parse_form4(filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, review rows). A purchase citing a prospectus goes to review only.

    Open market: False with an offering footnote, True otherwise, NULL for sales.
    """
    rows = explode_form4(filings)
    purchase = F.col("transaction_code") == "P"
    offering = offering_flag(F.col("footnote_text"))
    review = purchase & ~offering & prospectus_flag(F.col("footnote_text"))
    trades = rows.filter(~review).withColumn("is_open_market", F.when(purchase, ~offering))
    reviewed = rows.filter(review).select(
        "accession_number",
        "transaction_seq",
        "ticker",
        "filed_date",
        F.lit("prospectus_reference").alias("reason"),
        "footnote_text",
        "filing_url",
    )
    return trades, reviewed


def form4_listing(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed trades split by filing: (accessions to read in full, rows of sale-only filings).

    ``listing`` has record_type, security_type, transaction_code, accession_number,
    position and the row's values. Only filings with a purchase need their document;
    the others' rows are numbered in listed order.
    """
    rows = listing.filter(
        (F.col("record_type") == "transaction")
        & (F.col("security_type") == "non_derivative")
        & F.col("transaction_code").isin("P", "S")
    )
    bought = rows.filter(F.col("transaction_code") == "P").select("accession_number").distinct()
    sales = rows.join(bought, "accession_number", "left_anti")
    w = Window.partitionBy("accession_number").orderBy("position")
    return bought, sales.withColumn("transaction_seq", F.row_number().over(w) - 1)


def filings_from_arrays(batch: DataFrame, start) -> DataFrame:
    """Parallel arrays of a submissions listing to rows: form 4 and 4/A from ``start`` with a document."""
    rows = batch.select(
        "ticker", F.inline(F.arrays_zip("form", "filingDate", "accessionNumber", "primaryDocument"))
    )
    return rows.filter(
        F.col("form").isin("4", "4/A") & (F.col("filingDate") >= F.lit(str(start))) & (F.coalesce("primaryDocument", F.lit("")) != "")
    ).select(
        "ticker",
        F.col("accessionNumber").alias("accession_number"),
        F.col("filingDate").alias("filing_date"),
        F.col("primaryDocument").alias("primary_document"),
    )
