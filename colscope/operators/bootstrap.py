"""Scenario ranges of batch means: a bootstrap over every value of a column.

A draw is a position in the sorted values of its column, taken from a hash of the column name and
the draw number, so any engine gets the same draws in any order. The sorted values are never
gathered: equal values collapse to one record with a count, a distributed running total gives each
record its span of positions, and draws meet spans through an equi-join on position bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kinds import numeric_names
from ..functions.scalars import (
    as_double,
    clamp,
    col,
    finite,
    looks_like_id_for_simulation,
    relative_range,
    severity_rank,
    variation_coefficient,
)
from ..session import local_rows
from .clustering import _log_term
from .ordering import running_index
from .quantiles import exact_quantiles

# Limits of the simulation step.
SIMULATIONS = 5_000
BATCH = 250
LEAST_BATCH = 20
LEAST_VALUES = 30
HISTORY = [0.05, 0.50, 0.95]
# Draws per column that may be broadcast when the values outnumber them.
BROADCAST_DRAWS = 2_000_000

HISTORY_SCHEMA = (
    "position int, column string, valid_values bigint, batch int, hist_mean double, hist_std double, "
    "hist_min double, hist_p5 double, hist_p50 double, hist_p95 double, hist_max double, "
    "skewness double, outliers_iqr bigint"
)
SUMMARY_COLUMNS = [
    "position", "column", "valid_values", "hist_mean", "hist_std", "hist_min", "hist_p5", "hist_p50",
    "hist_p95", "hist_max", "sim_mean_p5", "sim_mean_p50", "sim_mean_p95", "sim_total_p5",
    "sim_total_p50", "sim_total_p95", "pct_above_p95", "pct_below_p5", "reading",
]
SUMMARY_SCHEMA = (
    HISTORY_SCHEMA
    + ", sim_mean_p5 double, sim_mean_p50 double, sim_mean_p95 double, sim_total_p5 double,"
    " sim_total_p50 double, sim_total_p95 double, pct_above_p95 double, pct_below_p5 double,"
    " relative_range double, cv double, reading string"
)


@dataclass
class BootstrapResult:
    applied: bool
    summary: DataFrame
    scenarios: DataFrame
    risks: DataFrame
    conclusion: DataFrame


def bootstrap_columns(
    profile: DataFrame, target: str = "", names: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Columns to simulate: an exactly named numeric target first, then the best scored ones, all or ``limit``."""
    c = F.col
    numeric = profile.where(c("analytic_type") == "numeric")
    if names is not None:
        numeric = numeric.where(c("column").isin(names))
    chosen = numeric.where(c("column") == target.strip())
    std, outliers = F.coalesce("std", F.lit(0.0)), F.coalesce("outliers_iqr", F.lit(0)).cast("double")
    id_like = (F.coalesce("distinct_pct", F.lit(0.0)) >= 95.0) & (c("rows") >= 500)
    fit = numeric.join(chosen.select("column"), "column", "left_anti").where(
        (c("null_pct") <= 40.0)
        & (std > 0)
        & (F.coalesce("distinct", F.lit(0)) > 5)
        & ~id_like
        & ~looks_like_id_for_simulation(c("column"))
    )
    # The weights.
    score = (
        0.45 * (1.0 - clamp(c("null_pct") / 100.0, 0.0, 1.0))
        + 0.25 * _log_term(F.abs(std), 10.0)
        + 0.20 * _log_term(outliers, 8.0)
        + 0.10 * clamp(F.abs(F.coalesce("skewness", F.lit(0.0))), 0.0, 5.0) / 5.0
    )
    kept = [
        "ordinal", "column", "score", "is_target", "finite", "finite_mean", "finite_std",
        "min", "max", "skewness", "outliers_iqr", "distinct",
    ]
    every = (
        chosen.withColumn("score", F.lit(None).cast("double"))
        .withColumn("is_target", F.lit(True))
        .select(*kept)
        .unionByName(fit.withColumn("score", score).withColumn("is_target", F.lit(False)).select(*kept))
    )
    order = [F.desc("is_target"), F.desc("score"), "ordinal"]
    every = every.orderBy(*order)
    return (every if limit is None else every.limit(limit)).select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"), *kept
    )


def draw_positions(
    spark: SparkSession, columns: list[tuple[int, str, int, int]], simulations: int
) -> DataFrame:
    """Rows (k, sim, pos) for columns given as (k, name, values, batch)."""
    parts = []
    for k, name, values, batch in columns:
        # 15 hex digits are 60 bits, so positions reach every row of a very large column.
        digits = F.substring(F.md5(F.concat(F.lit(f"{name}|"), F.col("id").cast("string"))), 1, 15)
        parts.append(
            spark.range(simulations * batch).select(
                F.lit(k).alias("k"),
                F.expr(f"id div {batch}").alias("sim"),
                (F.conv(digits, 16, 10).cast("bigint") % values).alias("pos"),
            )
        )
    return reduce(DataFrame.unionAll, parts)


def sorted_spans(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """Rows (k, v, n, start): every different finite value and the sorted positions it covers."""
    parts = [df.select(F.lit(k).alias("k"), finite(as_double(n)).alias("v")) for k, n in columns]
    counted = (
        reduce(DataFrame.unionAll, parts)
        .where(F.col("v").isNotNull())
        .groupBy("k", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return running_index(counted, ["v"], weight="n", group=["k"])


def simulated_batches(df: DataFrame, columns: list[dict], simulations: int) -> DataFrame:
    """Rows (k, sim, mean, above, below): one simulated batch each.

    ``columns`` hold position, column, valid_values, batch, hist_p5 and hist_p95.
    """
    spans = sorted_spans(df, [(c["position"], c["column"]) for c in columns])
    draws = draw_positions(
        df.sparkSession,
        [(c["position"], c["column"], c["valid_values"], c["batch"]) for c in columns],
        simulations,
    )
    # As many bins as draws: a bin then meets about one draw, and a value that fills a third of
    # the table is cut into at most a third of the bins.
    width, high, low = F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("double")
    for c in columns:
        this = F.col("k") == c["position"]
        bins = max(1, simulations * c["batch"])
        width = F.when(this, max(1, math.ceil(c["valid_values"] / bins))).otherwise(width)
        high = F.when(this, c["hist_p95"]).otherwise(high)
        low = F.when(this, c["hist_p5"]).otherwise(low)
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width)
    binned = spans.select("k", "v", "n", "start", F.explode(F.sequence(first, last)).alias("bin"))
    asked = draws.withColumn("bin", F.floor(F.col("pos") / width))
    most = max(c["valid_values"] for c in columns)
    amount = sum(simulations * c["batch"] for c in columns)
    if most > amount and amount <= BROADCAST_DRAWS:
        asked = F.broadcast(asked)
    hit = binned.join(asked, ["k", "bin"]).where(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("n"))
    )
    return (
        hit.withColumn("high", high)
        .withColumn("low", low)
        .groupBy("k", "sim")
        .agg(
            F.avg("v").alias("mean"),
            F.count_if(F.col("v") > F.col("high")).alias("above"),
            F.count_if(F.col("v") < F.col("low")).alias("below"),
            F.count(F.lit(1)).alias("draws"),
        )
    )


def bootstrap(
    df: DataFrame,
    profile: DataFrame,
    target: str = "",
    names: list[str] | None = None,
    simulations: int = SIMULATIONS,
    batch: int = BATCH,
) -> BootstrapResult:
    """Historical and simulated ranges, scenarios, risks and a conclusion."""
    spark = df.sparkSession
    names = numeric_names(df) if names is None else names
    history = _history(df, profile, target, names, batch)
    if not history:
        summary = local_rows(spark, [], SUMMARY_SCHEMA)
    else:
        summary = _summarize(df, spark, history, simulations)
    risks = bootstrap_risks(summary)
    return BootstrapResult(
        bool(history), summary, bootstrap_scenarios(summary), risks,
        bootstrap_conclusion(summary, risks, simulations),
    )


def _history(df, profile, target, names, batch) -> list[dict]:
    rows = [
        r for r in bootstrap_columns(profile, target, names).orderBy("rank").collect()
        if r["finite"] >= LEAST_VALUES and r["finite_std"] > 0
    ]
    if not rows:
        return []
    frame = df.select(*[finite(as_double(r["column"])).alias(r["column"]) for r in rows])
    edges = exact_quantiles(
        frame,
        {r["column"]: HISTORY for r in rows},
        {r["column"]: r["finite"] for r in rows},
        {r["column"]: r["distinct"] for r in rows if r["distinct"] is not None},
    )
    return [
        {
            "position": i, "column": r["column"], "valid_values": r["finite"],
            "batch": max(min(batch, r["finite"]), min(LEAST_BATCH, batch)),
            "hist_mean": r["finite_mean"], "hist_std": r["finite_std"], "hist_min": r["min"],
            "hist_p5": edges[(r["column"], 0.05)], "hist_p50": edges[(r["column"], 0.50)],
            "hist_p95": edges[(r["column"], 0.95)], "hist_max": r["max"],
            "skewness": r["skewness"], "outliers_iqr": r["outliers_iqr"],
        }
        for i, r in enumerate(rows, start=1)
    ]


def _summarize(df, spark, history, simulations) -> DataFrame:
    simulated = {
        r["k"]: r
        for r in simulated_batches(df, history, simulations)
        .groupBy("k")
        # One mean per simulation: the number of simulations bounds what is ranked here.
        .agg(
            F.percentile("mean", F.array(*map(F.lit, HISTORY))).alias("edges"),
            (F.sum("above") * 100.0 / F.sum("draws")).alias("above"),
            (F.sum("below") * 100.0 / F.sum("draws")).alias("below"),
        )
        .collect()
    }
    records = []
    for h in history:
        r = simulated[h["position"]]
        totals = [e * h["batch"] for e in r["edges"]]
        records.append((*h.values(), *r["edges"], *totals, r["above"], r["below"]))
    schema = SUMMARY_SCHEMA.split(", relative_range")[0]
    base = local_rows(spark, records, schema)
    spread = relative_range(F.col("sim_mean_p5"), F.col("sim_mean_p50"), F.col("sim_mean_p95"))
    cv = variation_coefficient(F.col("hist_std"), F.col("hist_mean"))
    reading = (
        F.when(F.col("relative_range") >= 1.0, "wide")
        .when(F.col("cv") >= 0.75, "volatile")
        .when(F.coalesce("outliers_iqr", F.lit(0)) > 0, "extremes")
        .otherwise("stable")
    )
    return base.withColumn("relative_range", spread).withColumn("cv", cv).withColumn("reading", reading)


def bootstrap_scenarios(summary: DataFrame) -> DataFrame:
    """Low, central and high scenario of every simulated column."""
    # Scenario names by percentile.
    kinds = [("low_p5", "p5", "low end of what batches usually show"),
             ("central_p50", "p50", "the batch to expect"),
             ("high_p95", "p95", "high end of what batches usually show")]
    entries = [
        F.struct(
            F.lit(i).alias("seq"), F.lit(name).alias("scenario"),
            F.col(f"sim_mean_{p}").alias("estimated_mean"), F.col(f"sim_total_{p}").alias("estimated_total"),
            F.lit(text).alias("interpretation"),
        )
        for i, (name, p, text) in enumerate(kinds)
    ]
    return summary.select("position", "column", F.inline(F.array(*entries)))


def bootstrap_risks(summary: DataFrame) -> DataFrame:
    """Signals of uncertainty, severe ones first."""
    c = F.col
    outlier_pct = c("outliers_iqr") * 100.0 / F.greatest(c("valid_values"), F.lit(1))

    def risk(seq, when_high, when_medium, indicator, value, text):
        severity = F.when(when_medium, "medium")
        if when_high is not None:
            severity = F.when(when_high, "high").when(when_medium, "medium")
        entry = F.struct(
            F.lit(seq).alias("seq"), severity.alias("severity"), F.lit(indicator).alias("indicator"),
            value.alias("value"), F.lit(text).alias("reading"),
        )
        return F.when(severity.isNotNull(), entry)

    # The limits of each signal.
    signals = F.array(
        risk(1, c("cv") >= 1.0, c("cv") >= 0.5, "variation_coefficient", c("cv"), "values spread widely around the mean"),
        risk(2, c("relative_range") >= 1.0, c("relative_range") >= 0.35, "relative_simulated_range", c("relative_range"), "low and high batches differ a lot"),
        risk(3, None, F.abs("skewness") >= 2.0, "skewness", c("skewness"), "lopsided values, the mean can mislead"),
        risk(4, None, outlier_pct >= 5.0, "outlier_pct", outlier_pct, "extreme values weigh on the high and low batches"),
    )
    rows = summary.select("position", "column", F.inline(F.filter(signals, lambda x: x.isNotNull())))
    order = Window.orderBy(F.desc(severity_rank(c("severity"))), "position", "seq")
    return rows.select(
        F.row_number().over(order).alias("rank"), "severity", "column", "indicator", "value", "reading"
    )


def bootstrap_conclusion(summary: DataFrame, risks: DataFrame, simulations: int = SIMULATIONS) -> DataFrame:
    """One row over all simulated columns; no row when nothing was simulated."""
    none = F.lit(None)
    both = summary.select("batch", none.cast("string").alias("severity")).unionByName(
        risks.select(none.cast("int").alias("batch"), "severity")
    )
    level = F.when(F.col("high_risks") > 0, "high").when(F.col("risks") > 0, "moderate").otherwise("stable")
    return (
        both.agg(
            F.count("batch").alias("columns"), F.min("batch").alias("batch"),
            F.count("severity").alias("risks"), F.count_if(F.col("severity") == "high").alias("high_risks"),
        )
        .where(F.col("columns") > 0)
        .select(
            F.lit(simulations).alias("simulations"), "batch", "columns", "risks", "high_risks",
            level.alias("level"),
            F.format_string(
                f"{simulations} simulated batches for %d columns: %d signals of uncertainty, %d of them high.",
                "columns", "risks", "high_risks",
            ).alias("conclusion"),
        )
    )
