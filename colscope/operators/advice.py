"""Chart advice, usefulness scores and the data behind the overview charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import abbreviate, clamp, severity_rank, whole_number
from ..session import local_rows
from .correlation import find_column, target_relevance

# Fixed value: the correlation that makes a scatter chart urgent.
SCATTER_URGENT = 0.90


def chart_advice(profile: DataFrame, strong: DataFrame | None = None) -> DataFrame:
    """One chart per column, then scatter charts for the strongest pairs; urgent ones first."""
    urgent = (F.col("analytic_type") == "numeric") & (F.coalesce("outliers_iqr", F.lit(0)) > 0)
    advice = profile.select(
        F.lit(1).alias("block"),
        F.col("ordinal").alias("seq"),
        "chart",
        F.col("column").alias("column_x"),
        F.lit("").alias("column_y"),
        F.when(urgent, "high").otherwise("medium").alias("priority"),
        F.concat(
            F.lit("type "), F.col("analytic_type"),
            F.format_string(", %.2f%% missing, ", "null_pct"),
            whole_number(F.col("distinct")), F.lit(" different values"),
        ).alias("reason"),
    )
    if strong is not None:
        scatter = strong.select(
            F.lit(2).alias("block"),
            F.col("rank").alias("seq"),
            F.lit("scatter").alias("chart"),
            F.col("column_1").alias("column_x"),
            F.col("column_2").alias("column_y"),
            F.when(F.col("abs_r") >= SCATTER_URGENT, "high").otherwise("medium").alias("priority"),
            F.format_string("%s relation with r=%.4f; shows the trend and possible duplicates", "strength", "r").alias("reason"),
        )
        advice = advice.unionByName(scatter)
    order = Window.orderBy(F.desc(severity_rank(F.col("priority"))), "block", "seq")
    return advice.select(
        F.row_number().over(order).alias("rank"), "priority", "chart", "column_x", "column_y", "reason"
    )


def usefulness_scores(profile: DataFrame) -> DataFrame:
    """Score per column from completeness, variety and an identifier penalty."""
    c = F.col
    completeness = 1.0 - clamp(c("null_pct") / 100.0, 0.0, 1.0)
    variety = (
        F.when(c("distinct").isNull(), 0.35)
        .when(c("distinct") <= 1, 0.0)
        .when((c("distinct") <= 50) & (c("analytic_type") == "categorical"), 0.75)
        .when(c("analytic_type") == "numeric", 1.0)
        .otherwise(0.45)
    )
    penalty = F.when(F.coalesce("distinct_pct", F.lit(0.0)) >= 95.0, 0.35).otherwise(1.0)
    # The weights.
    raw = (0.65 * completeness + 0.35 * variety) * penalty
    return profile.select(
        "ordinal", "column",
        c("analytic_type").alias("type"),
        raw.alias("score"),
        F.when(raw >= 0.75, "good_candidate").when(raw >= 0.50, "use_after_cleaning").otherwise("low_value").alias("advice"),
        F.concat(
            F.format_string("completeness=%.2f, distinct=", completeness),
            whole_number(c("distinct")), F.lit(", chart="), c("chart"),
        ).alias("detail"),
    )


def relevance_scores(relevance: DataFrame, target: str) -> DataFrame:
    size = F.abs("r")
    return relevance.select(
        "ordinal", "column",
        F.lit("target_relevance").alias("type"),
        clamp(size, 0.0, 1.0).alias("score"),
        F.when(size >= 0.70, "strong_variable").when(size >= 0.30, "candidate").otherwise("weak_relation").alias("advice"),
        F.format_string(f"r with target '{target.replace('%', '%%')}': %.4f", "r").alias("detail"),
    )


def ml_scores(
    profile: DataFrame, df: DataFrame | None = None, target: str = "", columns: list[str] | None = None
) -> DataFrame:
    """Usefulness for models, best first.

    With a numeric target among ``columns`` the score is |r| with it and replaces the general
    score; a target that cannot be used adds one warning row.
    """
    target = target.strip()
    if target and df is not None:
        names = columns if columns is not None else []
        if find_column(names, target) is not None:
            return _ranked(relevance_scores(target_relevance(df, target, names), target))
    scores = usefulness_scores(profile)
    if target:
        warning = local_rows(
            profile.sparkSession,
            [(-1, target, "target", 0.0, "target_unusable", "the target has to be one of the analysed numeric columns")],
            "ordinal int, column string, type string, score double, advice string, detail string",
        )
        scores = warning.unionByName(scores)
    return _ranked(scores)


def _ranked(scores: DataFrame) -> DataFrame:
    order = Window.orderBy(F.desc("score"), "ordinal")
    return scores.select(
        F.row_number().over(order).alias("rank"), "column", "type", "score", "advice", "detail"
    )


def _bars(rows: DataFrame, label, value, tie, limit: int) -> DataFrame:
    order = Window.orderBy(F.desc("value"), "tie")
    top = rows.select(label.alias("label"), value.alias("value"), tie.alias("tie"))
    top = top.orderBy(F.desc("value"), "tie").limit(limit)
    return top.select(F.row_number().over(order).alias("rank"), "label", "value")


def null_bars(profile: DataFrame, limit: int = 8) -> DataFrame:
    some = profile.where(F.col("null_pct") > 0)
    return _bars(some, F.col("column"), F.col("null_pct"), F.col("ordinal"), limit)


def distinct_bars(profile: DataFrame, limit: int = 8) -> DataFrame:
    known = profile.where(F.col("distinct_pct").isNotNull())
    return _bars(known, F.col("column"), F.col("distinct_pct"), F.col("ordinal"), limit)


def ml_bars(scores: DataFrame, limit: int = 10) -> DataFrame:
    label = F.concat("column", F.lit(" ("), "type", F.lit(")"))
    return _bars(scores, label, F.col("score") * 100, F.col("rank"), limit)


def cluster_bars(clusters: DataFrame, limit: int = 12) -> DataFrame:
    label = F.format_string("Cluster %d", "cluster")
    return _bars(clusters, label, F.col("pct"), F.col("rank"), limit)


def simulated_range_bars(summary: DataFrame, limit: int = 12) -> DataFrame:
    spread = F.col("sim_mean_p95") - F.col("sim_mean_p5")
    return _bars(summary, abbreviate(F.col("column"), 30), spread, F.col("position"), limit)
