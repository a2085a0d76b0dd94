"""Company filings: material 8-K events and shelf registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.functions.text import filing_impact, material_items, parse_day
from crosstide.operators.ranking import running_total
from crosstide.sources.tables import new_rows

# fixed values: issuers that file annual reports of another form instead
FOREIGN_FILERS = ("TSM", "ASML", "STM", "SAP")
SHELF_TEMPLATE = (
    "%s filed Form S-3 shelf registration. "
    "This signals potential upcoming capital raise which may be dilutive to existing shareholders."
)


def event_filings(landed: DataFrame, cutoff, foreign=FOREIGN_FILERS) -> DataFrame:
    """8-K rows with a material item filed on or after ``cutoff``, classified.

    ``landed`` has ticker, accession_number, filed_at, items (array) and text.
    """
    items = material_items(F.col("items"))
    rows = landed.filter(~F.col("ticker").isin(*foreign)).withColumn("_items", items)
    rows = rows.withColumn("filed_date", parse_day(F.col("filed_at"))).filter(
        (F.col("filed_date") >= F.lit(cutoff).cast("date")) & (F.size("_items") > 0)
    )
    none = F.lit(None).cast("string")
    return rows.select(
        "ticker",
        "filed_date",
        "accession_number",
        F.lit("8-K").alias("form_type"),
        F.array_join("_items", ",").alias("item_numbers"),
        filing_impact(F.col("_items"), F.lit(""), F.coalesce("text", F.lit("")), F.lit("8-K")).alias("impact"),
        none.alias("summary"),
        none.alias("sentiment"),
    )


def shelf_filings(landed: DataFrame, cutoff, foreign=FOREIGN_FILERS) -> DataFrame:
    """Shelf registrations: always HIGH and NEGATIVE with a fixed summary."""
    rows = landed.filter(~F.col("ticker").isin(*foreign)).withColumn("filed_date", parse_day(F.col("filed_at")))
    return rows.filter(F.col("filed_date") >= F.lit(cutoff).cast("date")).select(
        "ticker",
        "filed_date",
        "accession_number",
        F.coalesce("form_type", F.lit("S-3")).alias("form_type"),
        F.lit("S-3: Shelf Registration").alias("item_numbers"),
        F.lit("HIGH").alias("impact"),
        F.format_string(SHELF_TEMPLATE, "ticker").alias("summary"),
        F.lit("NEGATIVE").alias("sentiment"),
    )


def load_filings(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """New filings by accession number, with consecutive ids after the stored maximum.

    Ids follow (ticker, accession_number) and are numbered across partitions.
    """
    fresh = new_rows(existing, batch, ["accession_number"], ["ticker", "filed_date"])
    numbered = running_total(fresh, [], ["ticker", "accession_number"], out="_n")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return numbered.withColumn("id", (F.col("_n") + top).cast("long")).withColumn("saved_to_journal", F.lit(False)).drop("_n")
