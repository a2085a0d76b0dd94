"""Connected components of a link table, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.session import reliable_checkpoint


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): the smallest node reachable over the links, for every node that has one.

    Alternates large-star and small-star steps on the links until they stop changing: each
    node passes its smallest neighbour on to its larger (smaller) neighbours. Minima are
    pre-aggregated, and the links of a node that most others hang on are split by the
    join, not gathered. Each step is written to the checkpoint folder.
    Null ends and self-links are ignored; repeated links count once.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = reliable_checkpoint(edges.distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        hop = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = reliable_checkpoint(low.select("u", F.col("m").alias("v")).union(hop).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
