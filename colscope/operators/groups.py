"""Blocks of columns tied together by strong pairs: connected components of the pair graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize

# Fixed value: fewest columns in a group.
LEAST_MEMBERS = 3


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node name of each component as its label.

    Every round a node takes the smallest label around it and then its label's own label, so the
    number of rounds grows with the logarithm of the longest chain.
    """
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = materialize(ends.distinct())
    labels = ends.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    last = None
    while True:
        around = (
            ends.join(labels, ends["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lowered = labels.join(around, labels["node"] == around["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("low")
        )
        parents = lowered.select(F.col("node").alias("parent"), F.col("low").alias("above"))
        stepped = materialize(
            lowered.join(parents, F.col("low") == F.col("parent")).select(
                "node", F.least("low", "above").alias("label"), "old"
            )
        )
        changed = stepped.where(F.col("label") != F.col("old")).limit(1).count()
        labels = stepped.select("node", "label")
        if last is not None:
            discard(last)
        last = stepped
        if not changed:
            discard(ends)
            return labels


def column_groups(strong: DataFrame, threshold: float = 0.70, min_size: int = LEAST_MEMBERS) -> DataFrame:
    """Groups of at least ``min_size`` columns, largest first, then by first member."""
    edges = strong.where(F.col("abs_r") >= threshold).select(
        F.col("column_1").alias("a"), F.col("column_2").alias("b"), "abs_r"
    )
    labels = component_labels(edges)
    members = (
        labels.groupBy("label")
        .agg(F.array_sort(F.collect_list("node")).alias("columns"))
        .withColumn("size", F.size("columns"))
        .where(F.col("size") >= min_size)
    )
    strength = (
        edges.join(labels, edges["a"] == labels["node"])
        .groupBy("label")
        .agg(F.avg("abs_r").alias("mean_abs_r"), F.min("abs_r").alias("min_abs_r"))
    )
    order = Window.orderBy(F.desc("size"), "label")
    return members.join(strength, "label").select(
        F.row_number().over(order).alias("group"), "size", "mean_abs_r", "min_abs_r", "columns"
    )
