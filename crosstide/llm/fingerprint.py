"""Bottom-k document fingerprints of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.common import SPACE_CLASS, documents, sha256

WORDS = 5
K = 128


def add_sketch(df: DataFrame, text_col: str, out: str, words: int = WORDS, k: int = K) -> DataFrame:
    """Adds ``out``: the ``k`` smallest distinct shingle hashes of a text, ascending.

    Words are runs of anything but ASCII white space, lower-cased. A text of fewer than
    ``words`` words is one shingle; without words (or null) the sketch is empty.
    """
    w, s = f"_{out}_words", f"_{out}_hashes"
    df = df.withColumn(w, F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), f"{SPACE_CLASS}+"), lambda x: x != ""))
    n = F.size(w)
    grams = F.transform(
        F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(words)])
    )
    hashes = (
        F.when(n >= words, grams)
        .when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", F.col(w)))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    df = df.withColumn(s, hashes).withColumn(out, F.slice(F.sort_array(F.array_distinct(F.col(s))), 1, k))
    return df.drop(w, s)


def merge_sketches(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets; parts of a document or corpus merge in any order."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the sets behind two sketches; two empty sets are alike, one empty set is not."""
    union = merge_sketches(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s set that lies in ``b``'s; 1 for an empty ``a``."""
    j, na = resemblance(a, b, k), distinct_shingles(a, k)
    common = j * distinct_shingles(merge_sketches(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / na))


def as_hex(a: Column) -> Column:
    """Sketch as text: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str, cols: list[str], ranges: int | None = None) -> DataFrame:
    """Adds next_<col>: the values of the row with the next larger id, after the last one those of the first.

    Rows are dealt into id ranges of about equal size, bounded by ids that exist, and each
    range is ordered on its own. The first row of a range is also sent to the range
    before it, so rows meet their successor in one shuffle and no task holds more than a
    range. ``ranges`` is four times the shuffle partitions by default. Rows without an id
    come first, rows that share one are ordered by their values.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / ranges for i in range(ranges)]
    row = docs.agg(F.min(id_col), F.percentile_approx(id_col, at, 10_000)).first()
    starts = sorted({row[0], *(row[1] or [])} - {None})
    bounds = F.array(*map(F.lit, starts)) if len(starts) < 2 else F.lit(starts)
    steps = [1 << b for b in reversed(range(max(1, len(starts)).bit_length()))]
    ident = F.col(id_col)

    def further(found, step):
        fits = found + step <= len(starts)
        return F.when(fits & (F.get(bounds, found + step - 1) <= ident), found + step).otherwise(found)

    upto = F.aggregate(F.lit(steps), F.lit(0), further) if starts else F.lit(0)
    place = F.when(ident.isNull(), 0).otherwise(F.greatest(upto - 1, F.lit(0)))
    opens = (ident.isNull() if not starts else F.coalesce(ident == F.get(bounds, F.col("_range")), F.lit(True)))
    before = F.when(F.col("_range") == 0, max(0, len(starts) - 1)).otherwise(F.col("_range") - 1)
    copies = F.when(
        opens,
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy")), F.struct(before.alias("r"), F.lit(True).alias("copy"))),
    ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy"))))
    w = Window.partitionBy("_r").orderBy("_copy", F.col(id_col).asc_nulls_first(), *[F.xxhash64(c) for c in cols])
    dealt = (
        docs.withColumn("_range", place)
        .withColumn("_to", F.explode(copies))
        .select(*docs.columns, F.col("_to.r").alias("_r"), F.col("_to.copy").alias("_copy"))
    )
    for c in cols:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(w))
    return dealt.filter(~F.col("_copy")).drop("_r", "_copy")


def op8_fingerprints(spark, sf_dir) -> DataFrame:
    """Fingerprints of every text and of its edited form; see :func:`add_sketch` and :func:`with_next` for the edge cases."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(add_sketch(docs, "text", "own"), "doc_id", ["text", "own"])
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    out = add_sketch(paired, "edited", "other")
    return out.select(
        "doc_id",
        "n_chars",
        sha256(F.col("edited")).alias("edited_sha256"),
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own")).alias("near_next"),
    )
