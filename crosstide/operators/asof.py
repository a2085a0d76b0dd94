"""As-of, forward as-of and interval joins without range predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    probe: DataFrame,
    facts: DataFrame,
    by: Sequence[str],
    on: str,
    cols: Sequence[str],
    unique: bool = False,
    fact_date: str | None = None,
) -> DataFrame:
    """Left join each probe row with the latest fact whose ``on`` is not later.

    ``facts`` must be unique by (by, on). The window runs over facts and the
    *distinct* probe keys, so one key never holds more rows than there are dates,
    however many probe rows share it; the rows join back by equality.
    ``unique`` says the probe is unique by (by, on) already, which saves that join.
    ``fact_date`` names an output column for the matched fact's own date.
    """
    by = list(by)
    extra = [F.col(on).alias(fact_date)] if fact_date else []
    fact = facts.select(*by, on, F.struct(*[F.col(c) for c in cols], *extra).alias("_fact"), F.lit(0).alias("_side"))
    payload = [c for c in probe.columns if c not in (*by, on)]
    if unique:
        rows = probe.select(*by, on, F.struct(F.lit(1).alias("_"), *payload).alias("_payload"), F.lit(1).alias("_side"))
    else:
        rows = probe.select(*by, on).distinct().withColumn("_side", F.lit(1))
    both = rows.unionByName(fact, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_fact", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    out_cols = [*cols, *([fact_date] if fact_date else [])]
    hits = [F.col(f"_hit.{c}").alias(c) for c in out_cols]
    if unique:
        return found.select(*by, on, *[F.col(f"_payload.{c}").alias(c) for c in payload], *hits)
    return probe.join(found.select(*by, on, *hits), [*by, on], "left")


def asof_grid(
    facts: DataFrame, dates: DataFrame, by: Sequence[str], on: str, cols: Sequence[str], fact_date: str | None = None
) -> DataFrame:
    """The latest fact of every key on each of ``dates``: a row per (key, date) from the key's first fact on.

    A fact holds until the day before the key's next one, the last fact to the last of
    ``dates``. Its days are laid out and kept where they are asked for, so one window
    over the facts answers every probe, and probes meet the grid by equality.
    ``facts`` must be unique by (by, on); ``dates`` has distinct days in a column ``on``.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(on)
    extra = [F.col("_from").alias(fact_date)] if fact_date else []
    held = facts.filter(F.col(on).isNotNull()).select(
        *by, F.col(on).alias("_from"), F.date_sub(F.lead(on).over(w), 1).alias("_until"), *cols
    )
    # least() passes over the missing end of a last fact
    held = held.withColumn("_until", F.least("_until", dates.agg(F.max(on)).scalar())).filter("_from <= _until")
    days = held.withColumn(on, F.explode(F.sequence("_from", "_until")))
    return days.join(dates.select(on), on, "left_semi").select(*by, on, *cols, *extra)


def asof_forward(
    probe: DataFrame,
    facts: DataFrame,
    by: Sequence[str],
    on: str,
    value: str,
    steps: Sequence[int],
    include_same: bool = False,
    prefix: str = "fwd_",
) -> DataFrame:
    """For each probe row, ``value`` of the k-th fact strictly after ``on``, for k in ``steps``.

    With ``include_same`` the first fact on or after the date is step 0.
    The values ahead are leads on the fact side, so one as-of join answers all steps.
    """
    by = list(by)
    shift = 1 if include_same else 0
    names = [f"{prefix}{k}" for k in steps]
    w = Window.partitionBy(*by).orderBy(on)
    ahead = facts.select(
        *by,
        on,
        F.row_number().over(w).alias("_idx"),
        *[F.lead(value, k + shift).over(w).alias(n) for k, n in zip(steps, names)],
        # seen from before the first fact, the same step is one row nearer
        *[F.lead(value, k + shift - 1).over(w).alias(f"_0{n}") for k, n in zip(steps, names)],
    )
    keys = probe.select(*by, on).distinct().withColumn("_probe_on", F.col(on))
    if shift:
        keys = keys.withColumn(on, F.date_sub(on, shift))
    hit = asof_join(keys, ahead, by, on, ["_idx", *names], unique=True)
    first = ahead.filter(F.col("_idx") == 1).select(*by, *[f"_0{n}" for n in names])
    hit = hit.join(first, by, "left").select(
        *by,
        F.col("_probe_on").alias(on),
        *[F.when(F.col("_idx").isNull(), F.col(f"_0{n}")).otherwise(F.col(n)).alias(n) for n in names],
    )
    return probe.join(hit, [*by, on], "left")


def active_totals(
    events: DataFrame, by: Sequence[str], start: str, end: str, measures: Sequence[str], out: str = "date"
) -> DataFrame:
    """Per key and day, the totals of integer ``measures`` over the events active that day.

    An event adds its measures on its first day and takes them back the day after its
    last. The changes are summed per (key, day) before the shuffle and accumulated per
    key, so a busy key costs its days, not its events, and windows of any length cost
    two rows per event. Days without an active event have no row.
    """
    by, names = list(by), list(measures)
    spans = events.filter(F.col(start) <= F.col(end)).withColumn("_open", F.lit(1))
    change = F.explode(
        F.array(
            F.struct(F.col(start).alias("day"), F.lit(1).alias("sign")),
            F.struct(F.date_add(F.col(end), 1).alias("day"), F.lit(-1).alias("sign")),
        )
    )
    cols = [*names, "_open"]
    changes = (
        spans.select(*by, *cols, change.alias("_c"))
        .groupBy(*by, F.col("_c.day").alias(out))
        .agg(*[F.sum(F.col(c) * F.col("_c.sign")).cast("long").alias(c) for c in cols])
    )
    w = Window.partitionBy(*by).orderBy(out)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    levels = changes.select(
        *by, F.col(out).alias("_from"), F.lead(out).over(w).alias("_next"), *[F.sum(c).over(run).alias(c) for c in cols]
    ).filter(F.col("_open") > 0)
    days = F.explode(F.sequence(F.col("_from"), F.date_sub(F.col("_next"), 1)))
    return levels.select(*by, days.alias(out), *names)
