"""Cross-sectional ranks, scores and labels, and ranks over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.session import reliable_checkpoint


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column | None = None, out: str = "rank"
) -> DataFrame:
    """Running sum of ``weight`` (default 1, i.e. the row number) within ``keys`` along ``order``.

    Meant for groups too large for one task. Rows are range-partitioned on
    (keys, order), so a hot key or a hot score spreads over many partitions; the
    partition number is fixed by a checkpoint; each partition counts locally and
    adds the total of the partitions before it. Only the (key, partition) totals
    are ordered in one place. ``order`` must be unique within ``keys``.
    """
    keys, order = list(keys), list(order)
    weight = F.lit(1) if weight is None else weight
    placed = (
        df.withColumn("_w", weight.cast("long"))
        .repartitionByRange(*[F.col(c) for c in (*keys, *order)])
        .withColumn("_part", F.spark_partition_id())
    )
    placed = reliable_checkpoint(placed)
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_local", F.sum("_w").over(local))
        .join(offsets, [*keys, "_part"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_w", "_part", "_local", "_before")
    )


def ordinal_rank(
    df: DataFrame, keys: Sequence[str], col: str, ties: Sequence[str], out: str, pooled: bool = False
) -> DataFrame:
    """Ascending rank of ``col``; equal values are ordered by ``ties``."""
    if pooled:
        return running_total(df, keys, [col, *ties], out=out)
    w = Window.partitionBy(*keys).orderBy(col, *ties)
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def average_rank(df: DataFrame, keys: Sequence[str], col: str, out: str, pooled: bool = False) -> DataFrame:
    """Ascending rank of ``col``; equal values share their mean rank."""
    keys = list(keys)
    if pooled:
        # one row per distinct value, so ties are counted before anything is ordered
        values = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
        upto = running_total(values, keys, [col], weight=F.col("_n"), out="_upto")
        mean_rank = F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)
        return df.join(upto.select(*keys, col, mean_rank.alias(out)), [*keys, col])
    by_value = Window.partitionBy(*keys).orderBy(col)
    same = Window.partitionBy(*keys, col)
    return df.withColumn(
        out, F.rank().over(by_value) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)
    )


def with_cross_section(df: DataFrame, keys: Sequence[str], col: str, pooled: bool = False) -> DataFrame:
    """Strict percentile, competition rank (1 = highest) and size of each cross-section.

    Adds ``pct_below``, ``rank_desc`` and ``n_valid`` over the non-null values of
    ``col``. Null scores keep null percentile and rank. ``pooled`` handles
    cross-sections too large for one task.
    """
    keys = list(keys)
    if not pooled:
        group = Window.partitionBy(*keys)
        upward = group.orderBy(F.col(col).asc_nulls_last())
        n, known = F.count(col).over(group), F.col(col).isNotNull()
        below, upto = F.rank().over(upward) - 1, F.count(col).over(upward)  # equal values are peers
        return df.withColumns(
            {
                "pct_below": F.when(known, below / n.cast("double")),
                "rank_desc": F.when(known, n - upto + 1),
                "n_valid": F.when(known, n),
            }
        )
    valid = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    stats = running_total(valid, keys, [col], weight=F.col("_n"), out="_upto")
    sizes = valid.groupBy(*keys).agg(F.sum("_n").alias("n_valid"))
    stats = stats.join(sizes, keys) if keys else stats.withColumn("n_valid", sizes.scalar())
    stats = stats.select(
        *keys,
        col,
        ((F.col("_upto") - F.col("_n")) / F.col("n_valid").cast("double")).alias("pct_below"),
        (F.col("n_valid") - F.col("_upto") + 1).alias("rank_desc"),
        "n_valid",
    )
    return df.join(stats, [*keys, col], "left")


def action_label(pct: Column) -> Column:
    """Quintile label of a strict percentile; unknown percentile is HOLD."""
    return (
        F.when(pct.isNull(), "HOLD")
        .when(pct >= 0.80, "STRONG_BUY")
        .when(pct >= 0.60, "BUY")
        .when(pct >= 0.20, "HOLD")
        .otherwise("SELL")
    )


def regime(r: Column) -> Column:
    """Regime of a parent's 20-row return."""
    return (
        F.when(r.isNull(), "UNKNOWN")
        .when(r > 0, "UP")
        .when(r >= -0.05, "MILD_PULLBACK")
        .when(r >= -0.15, "CORRECTION")
        .otherwise("DRAWDOWN")
    )


def backtest_regime(r: Column) -> Column:
    """The same cuts under the names used in evaluation tables; unknown stays NULL."""
    return F.when(r > 0, "strong").when(r >= -0.05, "mild").when(r >= -0.15, "correction").when(r.isNotNull(), "drawdown")


def research_regime(r: Column) -> Column:
    """Six-way market regime used when comparing raw and adjusted strength."""
    return (
        F.when(r > 0.10, "STRONG_UP")
        .when(r > 0.02, "UP")
        .when(r >= -0.02, "FLAT")
        .when(r > -0.05, "MILD_PULLBACK")
        .when(r >= -0.15, "CORRECTION")
        .when(r.isNotNull(), "CRASH")
    )


def in_correction(r: Column) -> Column:
    return (r >= -0.15) & (r < -0.05)


def xs_zscore(df: DataFrame, keys: Sequence[str], col: str, out: str = "z", min_members: int = 3) -> DataFrame:
    """Population z-score within a group of bounded size, such as a basket on a date; NULL for small or constant groups."""
    group = Window.partitionBy(*keys)
    members = F.count(col).over(group)
    spread = F.nullif(F.stddev_pop(col).over(group), F.lit(0.0))
    return df.withColumn(out, F.when(members >= min_members, (F.col(col) - F.avg(col).over(group)) / spread))


def xs_minmax(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "norm_") -> DataFrame:
    """Min-max scaling within a group of bounded size; a flat group gives 0.5."""
    group = Window.partitionBy(*keys)

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(group), F.max(c).over(group)
        known = F.when(lo == hi, 0.5).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))
        return F.when(F.col(c).isNotNull(), known)

    return df.withColumns({prefix + c: scaled(c) for c in cols})


def mean_non_null(*cols: Column) -> Column:
    """Equal-weight mean of the non-null columns, NULL when all are null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    have = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return total / F.nullif(have, F.lit(0))


def weighted_mean_non_null(pairs: Sequence[tuple[Column, float]]) -> Column:
    """Weighted composite renormalised over the components that are present."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, w in pairs:
        total = total + F.when(c.isNotNull(), c * w).otherwise(0.0)
        weight = weight + F.when(c.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, total / F.nullif(weight, F.lit(0.0)))


def top_bottom(df: DataFrame, by: Sequence[str], col: str, n: int = 3, ties: Sequence[str] = ("ticker",)) -> DataFrame:
    """The ``n`` highest and ``n`` lowest rows of each group, without overlap.

    Adds ``side`` (top or bottom) and ``pos`` (1 = highest). A small group's rows all
    count as top first.
    """
    down = Window.partitionBy(*by).orderBy(F.desc(col), *ties)
    everything = Window.partitionBy(*by)
    return (
        df.withColumn("pos", F.row_number().over(down).cast("long"))
        .withColumn("_size", F.count(F.lit(1)).over(everything))
        .filter((F.col("pos") <= n) | (F.col("pos") > F.col("_size") - n))
        .withColumn("side", F.when(F.col("pos") <= n, "top").otherwise("bottom"))
        .drop("_size")
    )


def top_quintile(df: DataFrame, by: Sequence[str], col: str, ties: Sequence[str] = ("ticker",)) -> DataFrame:
    """The highest fifth of each group, at least one row."""
    sizes = Window.partitionBy(*by)
    w = Window.partitionBy(*by).orderBy(F.desc(col), *ties)
    return (
        df.withColumn("pos", F.row_number().over(w).cast("long"))
        .withColumn("_size", F.count(F.lit(1)).over(sizes))
        .filter(F.col("pos") <= F.greatest(F.lit(1), F.floor(F.col("_size") / 5)))
        .drop("_size")
    )


def rank_labels(
    df: DataFrame, by: Sequence[str], col: str, mode: str = "live", ties: Sequence[str] = ("ticker",)
) -> DataFrame:
    """LEADING for the top three; WEAKENING from rank 8 (live) or for the last three (backtest)."""
    if mode not in ("live", "backtest"):
        raise ValueError(f"unknown label mode {mode!r}")
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(col), *ties)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    weak = F.col("rank") >= 8 if mode == "live" else F.col("rank") > F.col("_size") - 3
    return (
        df.withColumn("rank", F.row_number().over(w).cast("long"))
        .withColumn("_size", size)
        .withColumn("label", F.when(F.col("rank") <= 3, "LEADING").when(weak, "WEAKENING").otherwise("NEUTRAL"))
        .drop("_size")
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by a partial aggregate (no window)."""
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), key).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """First ``n`` rows per key; the limit is pushed below the shuffle by Spark."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).filter(F.col(out) <= n)
