"""The whole analysis of one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.advice import chart_advice, ml_scores
from ..operators.bootstrap import BATCH, SIMULATIONS, BootstrapResult, bootstrap
from ..operators.clustering import MAX_ROUNDS, ClusterResult, cluster_rows
from ..operators.correlation import STRONG, pairwise_pearson, strong_pairs
from ..operators.groups import LEAST_MEMBERS, column_groups
from ..operators.insights import findings_digest, insights
from ..operators.ordering import row_hash
from ..operators.profile import profile_columns
from ..operators.selection import MIN_SCORE, analysis_columns, feature_selection, selection_summary
from ..session import local_rows, materialize


@dataclass
class Analysis:
    """Results as DataFrames; each is small, whatever the size of the table."""

    rows: int
    columns: int
    profile: DataFrame
    pairs: DataFrame
    groups: DataFrame
    selection: DataFrame
    selection_summary: DataFrame
    clusters: ClusterResult
    simulation: BootstrapResult
    insights: DataFrame
    digest: DataFrame
    advice: DataFrame
    ml: DataFrame
    used_columns: list[str]


def analyze(
    df: DataFrame,
    order_by: list[str] | None = None,
    threshold: float = STRONG,
    min_group: int = LEAST_MEMBERS,
    target: str = "",
    apply_selection: bool = True,
    min_score: float = MIN_SCORE,
    distinct: str = "exact",
    simulations: int = SIMULATIONS,
    batch: int = BATCH,
    max_rounds: int = MAX_ROUNDS,
) -> Analysis:
    """Profile, select, correlate, group, cluster, simulate and turn it all into findings.

    ``order_by`` fixes the row order the cluster seeds come from and names odd rows (by
    default a hash of the whole row); name a unique column where there is one. Several jobs read ``df``: pass a table scan, or
    ``materialize`` an expensive frame first.
    """
    spark = df.sparkSession
    ordered = df
    if order_by is None:
        name = "row_hash"
        while name in df.columns:
            name += "_"
        ordered, order_by = df.withColumn(name, row_hash(df)), [name]
    profile = profile_columns(df, distinct=distinct)
    names = analysis_columns(profile, min_score, apply_selection)
    pairs = _kept(strong_pairs(pairwise_pearson(df, names), threshold))
    groups = _kept(column_groups(pairs, threshold, min_group))
    clusters = cluster_rows(ordered, profile, order_by, names, max_rounds=max_rounds)
    simulation = bootstrap(df, profile, target, names, simulations, batch)
    selection = _kept(feature_selection(profile, pairs, min_score))
    summary = selection_summary(selection, names, min_score, apply_selection)
    found = _kept(insights(profile, pairs, groups, clusters, simulation, selection, summary))
    first = profile.agg(F.max("rows").alias("rows")).first()
    return Analysis(
        rows=first["rows"] or 0,
        columns=len(df.columns),
        profile=profile,
        pairs=pairs,
        groups=groups,
        selection=selection,
        selection_summary=summary,
        clusters=clusters,
        simulation=simulation,
        insights=found,
        digest=findings_digest(found, summary, pairs, groups, clusters, simulation),
        advice=chart_advice(profile, pairs),
        ml=ml_scores(profile, df, target, names),
        used_columns=names,
    )


def _kept(df: DataFrame) -> DataFrame:
    """Result tables have at most a row per column pair and are read by several later steps."""
    return materialize(df)


def summary_kpis(result: Analysis) -> DataFrame:
    """(metric, value) pairs of the overview."""
    spark = result.profile.sparkSession
    counted = [
        ("useful_columns", result.selection.where(F.col("decision") == "use")),
        ("review_columns", result.selection.where(F.col("decision") == "review")),
        ("dropped_columns", result.selection.where(F.col("decision") == "drop")),
        ("strong_pairs", result.pairs),
        ("groups", result.groups),
        ("insights", result.insights),
        ("high_alerts", result.insights.where(F.col("severity") == "high")),
        ("medium_alerts", result.insights.where(F.col("severity") == "medium")),
        ("chart_advice", result.advice),
        ("ml_scores", result.ml),
        ("clusters", result.clusters.clusters),
        ("odd_rows", result.clusters.summary),
        ("simulated_columns", result.simulation.summary),
    ]
    metrics = local_rows(
        spark, [("rows", result.rows), ("columns", result.columns)], "metric string, value bigint"
    )
    for name, frame in counted:
        # the summary has the number of odd rows, so they need not be ranked here
        value = F.coalesce(F.max("odd_rows"), F.lit(0)) if name == "odd_rows" else F.count(F.lit(1))
        metrics = metrics.unionByName(frame.agg(value.alias("value")).select(F.lit(name).alias("metric"), "value"))
    simulations = result.simulation.conclusion.agg(
        F.coalesce(F.max("simulations"), F.lit(0)).cast("bigint").alias("value")
    )
    return metrics.unionByName(simulations.select(F.lit("simulations").alias("metric"), "value"))
