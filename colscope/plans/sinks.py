"""The twelve result tables as CSV, and where they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col, fixed_decimals, whole_number
from .analyze import Analysis
from .report import html_report


def output_folder(path: str, base: str | None = None) -> str:
    """``profile_<stem>`` next to the input, or below ``base``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name.lstrip(".") else name
    parent = base.rstrip("/") if base is not None else (folder or ("" if path.startswith("/") else "."))
    return f"{parent}/profile_{stem or 'table'}"


# How cells are written and read: quoted only where needed, quotes doubled, blanks kept.
CSV = {
    "header": True, "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """Files with a header; cells are blank for null and empty.

    A small table goes to one file. A large one is written in as many parts as it has, in its order.
    """
    (df.coalesce(1) if single else df).write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cells of ``write_csv`` as text, in all files of the path; blank ones are empty text."""
    read = spark.read.options(**CSV).option("multiLine", True).option("inferSchema", False).csv(path)
    return read.na.fill("")


def _numbers(df: DataFrame, order: str | list[str], columns: list[tuple[str, int | None]]) -> DataFrame:
    """Columns in report order; a digit count prints a number with that many decimals."""
    out: list[Column] = []
    for name, digits in columns:
        c = col(name) if digits is None else fixed_decimals(col(name), digits)
        out.append(c.alias(name))
    keys = [order] if isinstance(order, str) else order
    return df.orderBy(*keys).select(*out)


def csv_profile(profile: DataFrame) -> DataFrame:
    """The profile as its file prints it; no other result takes part in it."""
    counts = ("distinct", "zeros", "negatives", "outliers_iqr", "outliers_z")
    stats = [(n, 6) for n in ("mean", "q1", "median", "q3", "min", "max", "std", "iqr", "skewness", "kurtosis")]
    return _numbers(profile.withColumns({n: whole_number(F.col(n)) for n in counts}), "ordinal", [
        ("column", None), ("physical_type", None), ("analytic_type", None), ("rows", None),
        ("non_null", None), ("nulls", None), ("null_pct", 4), ("distinct", None), ("distinct_pct", 6),
        *stats, *[(n, None) for n in counts[1:]], ("chart", None)])


def csv_tables(result: Analysis, odd_rows: int | None = None) -> dict[str, DataFrame]:
    """File name to formatted table, one per result; of the odd rows all, or so many of the farthest."""
    keys = [n for n in result.clusters.odd_rows.columns if n not in (
        "rank", "cluster", "distance", "z_score", "severity", "reason", "explanation")]
    simulated = [(n, 8) for n in (
        "hist_mean", "hist_std", "hist_min", "hist_p5", "hist_p50", "hist_p95", "hist_max",
        "sim_mean_p5", "sim_mean_p50", "sim_mean_p95", "sim_total_p5", "sim_total_p50", "sim_total_p95")]
    groups = result.groups.withColumn("columns", F.array_join("columns", "; "))
    odd = result.clusters.odd_rows
    odd = odd if odd_rows is None else odd.where(F.col("rank") <= odd_rows)
    return {
        "profile": csv_profile(result.profile),
        "strong_pairs": _numbers(result.pairs, "rank", [
            ("column_1", None), ("column_2", None), ("r", 8), ("abs_r", 8), ("strength", None)]),
        "column_groups": _numbers(groups, "group", [
            ("group", None), ("size", None), ("mean_abs_r", 6), ("min_abs_r", 6), ("columns", None)]),
        "insights": _numbers(result.insights, "rank", [
            ("severity", None), ("category", None), ("subject", None), ("message", None)]),
        "chart_advice": _numbers(result.advice, "rank", [
            ("priority", None), ("chart", None), ("column_x", None), ("column_y", None), ("reason", None)]),
        "feature_selection": _numbers(result.selection, "position", [
            ("decision", None), ("score", 6), ("column", None), ("analytic_type", None), ("null_pct", 6),
            ("distinct_pct", 6), ("max_correlation", 6), ("correlated_with", None), ("risk", None),
            ("reasons", None), ("actions", None)]),
        "ml_scores": _numbers(result.ml, "rank", [
            ("score", 6), ("column", None), ("type", None), ("advice", None), ("detail", None)]),
        "clusters": _numbers(result.clusters.clusters, "rank", [
            ("cluster", None), ("size", None), ("pct", 6), ("mean_distance", 6), ("reading", None)]),
        "odd_rows": _numbers(_printable(odd, keys), "rank", [
            ("rank", None), *[(k, None) for k in keys], ("cluster", None), ("distance", 8), ("z_score", 6),
            ("severity", None), ("reason", None), ("explanation", None)]),
        "bootstrap_summary": _numbers(result.simulation.summary, "position", [
            ("column", None), ("valid_values", None), *simulated, ("pct_above_p95", 6), ("pct_below_p5", 6),
            ("reading", None)]),
        "bootstrap_scenarios": _numbers(
            result.simulation.scenarios, ["position", "seq"], [
                ("column", None), ("scenario", None), ("estimated_mean", 8), ("estimated_total", 8),
                ("interpretation", None)]),
        "bootstrap_risks": _numbers(result.simulation.risks, "rank", [
            ("severity", None), ("column", None), ("indicator", None), ("value", 8), ("reading", None)]),
    }


def _printable(df: DataFrame, keys: list[str]) -> DataFrame:
    """CSV has no nested or binary cells; such keys are written as JSON or hex text."""
    shown = {}
    for f in df.schema.fields:
        if f.name in keys and f.dataType.typeName() in ("array", "struct", "map"):
            shown[f.name] = F.to_json(col(f.name))
        elif f.name in keys and f.dataType.typeName() == "binary":
            shown[f.name] = F.hex(col(f.name))
    return df.withColumns(shown) if shown else df


def write_results(result: Analysis, folder: str, odd_rows: int | None = None) -> None:
    """Twelve CSV tables and the HTML report. Odd rows grow with the table, so they take several files."""
    for name, table in csv_tables(result, odd_rows).items():
        write_csv(table, f"{folder}/{name}.csv", single=name != "odd_rows" or odd_rows is not None)
    html_report(result).coalesce(1).write.mode("overwrite").text(f"{folder}/report.html")
