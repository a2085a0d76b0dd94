"""Information coefficients: rank correlation of a score with a forward return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators.ranking import average_rank, ordinal_rank
from crosstide.session import reliable_checkpoint


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL instead of an error when a side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(
    obs: DataFrame,
    keys: Sequence[str],
    rank: str = "average",
    min_n: int = 5,
    ties: Sequence[str] = ("date", "ticker"),
    pooled: bool = False,
    score: str = "score",
    fwd: str = "fwd",
) -> DataFrame:
    """One row per key with ``n`` and ``ic``.

    rank    average: ties share their mean rank; ordinal: ties ordered by ``ties``
    min_n   fewer pairs give a NULL ic, as does a constant side
    pooled  set it when a group is not bounded by one date's cross-section or one
            ticker's history: the ranks are then computed across partitions
    """
    keys = list(keys)
    clean = obs.filter(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    if pooled and rank == "average":
        # both rankings and their joins read the pairs: they are derived once
        clean = reliable_checkpoint(clean.select(*keys, score, fwd))
    if rank == "average":
        ranked = average_rank(clean, keys, score, "_rx", pooled)
        ranked = average_rank(ranked, keys, fwd, "_ry", pooled)
    elif rank == "ordinal":
        ranked = ordinal_rank(clean, keys, score, ties, "_rx", pooled)
        ranked = ordinal_rank(ranked, keys, fwd, ties, "_ry", pooled)
    else:
        raise ValueError(f"unknown rank {rank!r}")
    ic = guarded_corr(F.col("_rx").cast("double"), F.col("_ry").cast("double"))
    return (
        ranked.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), ic.alias("_ic"))
        .withColumn("ic", F.when(F.col("n") >= min_n, F.col("_ic")))
        .drop("_ic")
    )


def pearson(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of two signals over the rows where both exist."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), guarded_corr(F.col(a), F.col(b)).alias("corr")
    )


def ic_summary(ics: DataFrame, keys: Sequence[str], ddof: int = 1) -> DataFrame:
    """Mean, deviation and information ratio of per-date ICs; skipped dates (NULL ic) do not count."""
    dev = F.stddev_samp("ic") if ddof else F.stddev_pop("ic")
    n = F.count("ic")
    std = F.when(n >= 2, dev)
    return (
        ics.groupBy(*keys)
        .agg(n.alias("n_dates"), F.avg("ic").alias("ic_mean"), std.alias("ic_std"))
        .withColumn("ic_ir", F.col("ic_mean") / F.nullif(F.col("ic_std"), F.lit(0.0)))
    )


def with_date_half(obs: DataFrame, keys: Sequence[str] = (), out: str = "half") -> DataFrame:
    """H1 for dates before the middle distinct date of the group, else H2.

    Only the distinct dates are ordered in one place: at most one row per trading day.
    """
    keys = list(keys)
    days = obs.select(*keys, "date").distinct()
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    pos = F.row_number().over(part.orderBy("date")) - 1
    n = F.count(F.lit(1)).over(part)
    halves = days.withColumn(out, F.when(pos < F.floor(n / 2), "H1").otherwise("H2"))
    return obs.join(halves, [*keys, "date"])


def with_row_half(obs: DataFrame, keys: Sequence[str], order: Sequence[str] = ("date",), out: str = "half") -> DataFrame:
    """H1 for the first n // 2 rows of the group in ``order`` (groups bounded by the calendar)."""
    part = Window.partitionBy(*keys)
    pos = F.row_number().over(part.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(part)
    return obs.withColumn(out, F.when(pos < F.floor(n / 2), "H1").otherwise("H2"))


def with_all(obs: DataFrame, col: str = "half", label: str = "ALL") -> DataFrame:
    """Repeat each row under ``label`` as well as its own value of ``col``."""
    return obs.withColumn(col, F.explode(F.array(F.lit(label), F.col(col))))


def pivot_halves(ics: DataFrame, keys: Sequence[str], value: str = "ic") -> DataFrame:
    """ALL / H1 / H2 rows to columns ic, ic_h1, ic_h2 and n."""
    return ics.groupBy(*keys).agg(
        F.max(F.when(F.col("half") == "ALL", F.col("n"))).alias("n"),
        F.max(F.when(F.col("half") == "ALL", F.col(value))).alias("ic"),
        F.max(F.when(F.col("half") == "H1", F.col(value))).alias("ic_h1"),
        F.max(F.when(F.col("half") == "H2", F.col(value))).alias("ic_h2"),
    )


def long_horizons(df: DataFrame, horizons: Sequence[int], convention: str, price: str = "adj_close") -> DataFrame:
    """Add forward returns and unpivot them to (horizon, fwd)."""
    from crosstide.operators.features import forward_return

    wide = df.withColumn(
        "_f",
        F.array(*[F.struct(F.lit(h).alias("horizon"), forward_return(h, convention, price).alias("fwd")) for h in horizons]),
    )
    return wide.withColumn("_f", F.explode("_f")).select(*df.columns, "_f.horizon", "_f.fwd")
