"""Findings: every rule turns rows of an earlier result into (severity, category, subject, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank
from .bootstrap import BootstrapResult
from .clustering import SMALL_SEGMENT_PCT, ClusterResult

# The limits of the rules.
NEAR_DUPLICATE = 0.95
MANY_ODD_ROWS = 20

COLUMNS = ["block", "item", "rule", "category", "severity", "subject", "message"]


def _finding(block: int, item, rule: int, category: str, severity, subject, message) -> list[Column]:
    def as_col(x):
        return x if isinstance(x, Column) else F.lit(x)

    values = [as_col(block), as_col(item).cast("int"), as_col(rule), as_col(category), as_col(severity), as_col(subject), as_col(message)]
    return [v.alias(n) for v, n in zip(values, COLUMNS)]


def column_findings(profile: DataFrame) -> DataFrame:
    """Gaps, constants, identifiers, outliers and skew."""
    c = F.col
    examined = F.greatest(c("finite"), F.lit(1))
    outlier_pct = c("outliers_iqr") * 100.0 / examined

    def rule(number, category, condition, severity, message):
        entry = F.struct(*_finding(1, c("ordinal"), number, category, severity, c("column"), message))
        return F.when(condition, entry)

    found = F.array(
        rule(1, "quality", c("null_pct") >= 20.0, F.when(c("null_pct") >= 50.0, "high").otherwise("medium"),
             F.format_string("blank in %.2f%% of the rows", "null_pct")),
        rule(2, "variability", c("distinct") == 1, "medium", "same value in every row that has one"),
        rule(3, "identifier", (c("distinct_pct") >= 95.0) & (c("rows") > 100), "low",
             F.format_string("%.2f%% distinct: tells rows apart, groups none", "distinct_pct")),
        rule(4, "outliers", outlier_pct >= 5.0, "medium",
             F.format_string("%.2f%% beyond 1.5 quartile ranges; means and deviations lean on them", outlier_pct)),
        rule(5, "distribution", F.abs("skewness") >= 2.0, "low",
             F.format_string("skewness %.2f: median and mean tell different stories", "skewness")),
    )
    return profile.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def pair_findings(strong: DataFrame) -> DataFrame:
    close = strong.where(F.col("abs_r") >= NEAR_DUPLICATE)
    subject = F.concat("column_1", F.lit(" ~ "), "column_2")
    message = F.format_string("r=%.4f: each can be computed from the other almost exactly", "r")
    return close.select(*_finding(2, F.col("rank"), 1, "redundancy", "medium", subject, message))


def group_findings(groups: DataFrame) -> DataFrame:
    message = F.format_string("%d columns linked by strong correlations", "size")
    subject = F.format_string("Group %d", "group")
    return groups.select(*_finding(3, F.col("group"), 1, "group", "low", subject, message))


def cluster_findings(result: ClusterResult) -> DataFrame:
    counted = result.summary.where(F.col("odd_rows") > 0)
    severity = F.when(F.col("odd_rows") >= MANY_ODD_ROWS, "high").otherwise("medium")
    message = F.format_string("%d rows lie far from the centre of their cluster", "odd_rows")
    odd = counted.select(*_finding(4, 0, 1, "kmeans", severity, "odd rows", message))
    order = Window.orderBy("rank")
    small = (
        result.clusters.where(F.col("pct") <= SMALL_SEGMENT_PCT)
        .withColumn("place", F.row_number().over(order))
    )
    text = F.format_string("%.2f%% of the rows; compare a few of them with the rest", "pct")
    subject = F.format_string("Cluster %d", "cluster")
    return odd.unionByName(small.select(*_finding(4, F.col("place"), 2, "small_segment", "medium", subject, text)))


def bootstrap_findings(result: BootstrapResult) -> DataFrame:
    some = result.conclusion.where(F.col("risks") > 0)
    severity = F.when(F.col("high_risks") > 0, "high").otherwise("medium")
    message = F.format_string("%d signals of uncertainty in %d columns", "risks", "columns")
    head = some.select(*_finding(5, 0, 1, "montecarlo", severity, "simulated scenarios", message))
    text = F.format_string("%s = %.4f: %s", "indicator", "value", "reading")
    return head.unionByName(
        result.risks.select(*_finding(5, F.col("rank"), 2, "risk", F.col("severity"), F.col("column"), text))
    )


def selection_findings(selection: DataFrame, summary: DataFrame) -> DataFrame:
    severity = F.when(F.col("n_drop") > F.col("n_use"), "medium").otherwise("low")
    head = summary.select(*_finding(6, 0, 1, "feature_selection", severity, "all columns", F.col("conclusion")))
    order = Window.orderBy("position")
    drops = (
        selection.where(F.col("decision") == "drop")
        .withColumn("place", F.row_number().over(order))
    )
    level = F.when(F.col("risk") == "high", "high").otherwise("medium")
    text = F.concat(F.lit("can be dropped: "), "actions", F.lit(". Why: "), "reasons")
    return head.unionByName(
        drops.select(*_finding(6, F.col("place"), 2, "feature_selection", level, F.col("column"), text))
    )


def insights(
    profile: DataFrame,
    strong: DataFrame | None = None,
    groups: DataFrame | None = None,
    clusters: ClusterResult | None = None,
    simulation: BootstrapResult | None = None,
    selection: DataFrame | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """All findings: severe ones first, the selection findings always last in their own order."""
    parts = [column_findings(profile)]
    if strong is not None:
        parts.append(pair_findings(strong))
    if groups is not None:
        parts.append(group_findings(groups))
    if clusters is not None and clusters.applied:
        parts.append(cluster_findings(clusters))
    if simulation is not None and simulation.applied:
        parts.append(bootstrap_findings(simulation))
    if selection is not None and summary is not None:
        parts.append(selection_findings(selection, summary))
    every = reduce(DataFrame.unionByName, parts)
    last = F.col("block") == 6
    order = Window.orderBy(
        last, F.when(last, 0).otherwise(-severity_rank(F.col("severity"))), "block", "item", "rule"
    )
    return every.select(
        F.row_number().over(order).alias("rank"), "severity", "category", "subject", "message"
    )


def findings_digest(
    found: DataFrame,
    summary: DataFrame | None = None,
    strong: DataFrame | None = None,
    groups: DataFrame | None = None,
    clusters: ClusterResult | None = None,
    simulation: BootstrapResult | None = None,
    first: int | None = None,
) -> DataFrame:
    """What to look at: one line per analysis, then the findings, all or the ``first`` ones."""
    parts = []

    def line(block, source, topic, severity, message, item=F.lit(0)):
        parts.append(
            source.select(
                F.lit(block).alias("block"), item.alias("item"),
                (topic if isinstance(topic, Column) else F.lit(topic)).alias("topic"),
                (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
                message.alias("message"),
            )
        )

    c = F.col
    if summary is not None:
        line(1, summary, "useful_columns", F.when(c("n_drop") > c("n_use"), "medium").otherwise("low"), c("conclusion"))
    if clusters is not None and clusters.applied:
        line(2, clusters.summary, "odd_rows", F.when(c("odd_rows") > 0, "high").otherwise("low"), c("conclusion"))
    else:
        one = found.sparkSession.range(1)
        line(2, one, "clustering_not_applied", "low", F.lit("not enough usable numeric columns for clusters; this is not an error"))
    if simulation is not None and simulation.applied:
        line(3, simulation.conclusion, "scenarios", F.when(c("high_risks") > 0, "high").otherwise("medium"), c("conclusion"))
    if strong is not None:
        text = F.format_string("%s and %s move almost together (r=%.4f)", "column_1", "column_2", "r")
        level = F.when(c("abs_r") >= NEAR_DUPLICATE, "high").otherwise("medium")
        line(4, strong.where(c("rank") == 1), "strong_pair", level, text)
    if groups is not None:
        text = F.format_string("a block of %d columns behaves alike", "size")
        line(5, groups.where(c("group") == 1), "column_block", "medium", text)
    text = F.concat("subject", F.lit(": "), "message")
    line(6, found if first is None else found.where(c("rank") <= first), c("category"), c("severity"), text, c("rank"))
    every = reduce(DataFrame.unionByName, parts)
    order = Window.orderBy("block", "item")
    return every.select(F.row_number().over(order).alias("rank"), "severity", "topic", "message")
