"""One-hop lookups on the dependency edges (parent, child, edge_type, weight, notes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE_SCHEMA = "parent string, child string, edge_type string, weight double, notes string, position long"


def load_edges(spark: SparkSession, rows) -> DataFrame:
    """Edges from dict rows (parent, child, type, weight, notes); ``position`` keeps file order."""
    data = [
        (r["parent"], r["child"], r["type"], float(r["weight"]), r.get("notes") or "", i)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, EDGE_SCHEMA)


def dependents(edges: DataFrame, parent: str) -> DataFrame:
    return edges.filter(F.col("parent") == parent)


def parents(edges: DataFrame, child: str) -> DataFrame:
    return edges.filter(F.col("child") == child)


def edge_weight(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Weight of one edge: the first in file order, no row when unknown."""
    hit = edges.filter((F.col("parent") == parent) & (F.col("child") == child))
    return hit.groupBy("parent", "child").agg(F.min_by("weight", "position").alias("weight"))


def best_parent(edges: DataFrame) -> DataFrame:
    """Highest-weight parent per child; the earlier edge wins a tie."""
    pick = F.max_by(F.struct("parent", "weight"), F.struct("weight", (-F.col("position")).alias("p")))
    return edges.groupBy("child").agg(pick.alias("_e")).select("child", "_e.parent", "_e.weight")


def universe(edges: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct tickers of the graph and of any further one-column ticker sets."""
    out = edges.select(F.col("parent").alias("ticker")).union(edges.select("child"))
    for o in others:
        out = out.union(o.select("ticker"))
    return out.filter(F.col("ticker").isNotNull()).distinct()


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row per (parent, child): the first in file order."""
    w = Window.partitionBy("parent", "child").orderBy("position")
    return edges.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
