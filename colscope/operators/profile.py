"""Column profile: one row per column, computed over the whole table.

Four kinds of scans, each reading only the columns it needs:
1. counts and range of every column (map-side combined, one row per task);
2. means and variances from error-free sums, scaled by the ranges found before;
3. exact distinct counts and exact quartiles;
4. shape and outlier counts against the means and fences found before.
Only one record per column reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import analytic_type, schema_kind, suggested_chart
from ..functions.scalars import as_double, col, finite, share
from ..session import local_rows
from .distinct import approximate_distinct, exact_distinct
from .measures import measure
from .quantiles import SAMPLE, SMALL, sketch_quantiles, values_at_positions
from .sums import exact_moments
from .value_counts import IN_ONE_TASK, ValueCounts, countable, value_counts

NUMERIC_PER_SCAN = 8
OTHERS_PER_SCAN = 32
SCANS_PER_JOB = 24
# Fewest values for quartiles and shape, fence width, z limit.
LEAST_VALUES = 4
FENCE_WIDTH = 1.5
Z_LIMIT = 3.0

_FACTS = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("physical_type", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("rows", T.LongType(), False),
        T.StructField("non_null", T.LongType(), False),
        T.StructField("distinct", T.LongType()),
        *[T.StructField(n, T.DoubleType()) for n in ("mean", "q1", "median", "q3", "min", "max", "std")],
        *[T.StructField(n, T.DoubleType()) for n in ("skewness", "kurtosis")],
        *[T.StructField(n, T.LongType()) for n in ("zeros", "negatives", "outliers_iqr", "outliers_z")],
        T.StructField("finite", T.LongType()),
        T.StructField("finite_mean", T.DoubleType()),
        T.StructField("finite_std", T.DoubleType()),
    ]
)

# The order of the report columns, then the moments that later steps start from.
PROFILE_COLUMNS = [
    "column", "physical_type", "analytic_type", "rows", "non_null", "nulls", "null_pct",
    "distinct", "distinct_pct", "mean", "q1", "median", "q3", "min", "max", "std", "iqr",
    "skewness", "kurtosis", "zeros", "negatives", "outliers_iqr", "outliers_z", "chart",
]
MOMENT_COLUMNS = ["finite", "finite_mean", "finite_std"]


def profile_columns(
    df: DataFrame,
    distinct: str = "exact",
    include_decimal: bool = False,
    small: int = SMALL,
    sample: int = SAMPLE,
    ranks: str = "exact",
) -> DataFrame:
    """Profile of every column, in column order.

    ``distinct="approx"`` counts with a sketch and re-counts exactly near rule thresholds.
    ``ranks="sketch"`` takes quartiles and medians from sketches (see ``sketch_quantiles``); with
    both, no values are shuffled at all.
    """
    if ranks not in ("exact", "sketch"):
        raise ValueError("ranks must be 'exact' or 'sketch'")
    fields = df.schema.fields
    facts = [
        {
            "ordinal": i,
            "column": f.name,
            "physical_type": f.dataType.simpleString(),
            "kind": schema_kind(f.dataType, include_decimal),
        }
        for i, f in enumerate(fields)
    ]
    numeric = {x["column"]: x for x in facts if x["kind"] == "numeric"}
    _count_and_average(df, facts)
    rows = facts[0]["rows"] if facts else 0
    # In the exact mode one frame of value counts serves the distinct counts and the ranks.
    counted = [f.name for f in fields if f.name in numeric and countable(f.dataType)] if distinct == "exact" else []
    values = value_counts(df, counted) if counted else None
    _count_distinct(df, facts, rows, distinct, values)
    frame = df.select(*[finite(as_double(n)).alias(n) for n in numeric])
    _average(frame, numeric)
    if ranks == "sketch":
        _sketch(frame, numeric)
    else:
        _rank(frame, numeric, small, sample, values)
    if values:
        values.release()
    _measure_shape(frame, numeric)
    return _as_profile(df, facts)


_COUNTED = ("non_null", "finite", "finite_mean", "min", "max", "zeros", "negatives", "lowest")


def _count_and_average(df: DataFrame, facts: list[dict]) -> None:
    numeric = [x for x in facts if x["kind"] == "numeric"]
    others = [x for x in facts if x["kind"] != "numeric"]
    scans = _cut(numeric, NUMERIC_PER_SCAN) + _cut(others, OTHERS_PER_SCAN)
    for job in _cut(scans, SCANS_PER_JOB):
        groups = []
        for part in job:
            group = [F.count(F.lit(1))]
            for x in part:
                group.append(F.count(col(x["column"])))
                if x["kind"] == "numeric":
                    value = as_double(x["column"])
                    f = finite(value)
                    group += [
                        F.count(f), F.avg(f), F.min(f), F.max(f),
                        F.count_if(f == 0), F.count_if(f < 0), F.count_if(value == -math.inf),
                    ]
            groups.append(group)
        for part, values in zip(job, measure(df, groups)):
            row = iter(values)
            total = int(next(row))
            for x in part:
                x["rows"] = total
                for name in _COUNTED[: len(_COUNTED) if x["kind"] == "numeric" else 1]:
                    value = next(row)
                    whole = name in ("non_null", "finite", "zeros", "negatives", "lowest")
                    x[name] = int(value) if whole else value


def _average(frame: DataFrame, numeric: dict) -> None:
    """Means and variances without the rounding of long sums, in place of the plain means."""
    for job in _cut(list(numeric.values()), NUMERIC_PER_SCAN):
        known = {x["column"]: (x["finite"], x["finite_mean"], x["min"], x["max"]) for x in job}
        found = exact_moments(frame, known)
        for x in job:
            moments = found.get(x["column"])
            x["finite_mean"], x["var"] = (moments.mean, moments.variance) if moments else (None, None)


def _cut(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _count_distinct(df: DataFrame, facts: list[dict], rows: int, mode: str, values: ValueCounts | None) -> None:
    names = [x["column"] for x in facts]
    if mode == "exact":
        known = values.distinct if values else {}
        counted = exact_distinct(df, [n for n in names if n not in known]) | known
    elif mode == "approx":
        counted = approximate_distinct(df, names, rows)
    else:
        raise ValueError("distinct must be 'exact' or 'approx'")
    for x in facts:
        if x["column"] in counted:
            # Null counts as one more value; an estimate never exceeds what is possible.
            has_null = int(x["non_null"] < x["rows"])
            x["distinct"] = min(counted[x["column"]], x["non_null"]) + has_null


def _rank(frame: DataFrame, numeric: dict, small: int, sample: int, values: ValueCounts | None) -> None:
    counts = {n: x["finite"] for n, x in numeric.items()}
    clean = {n for n, x in numeric.items() if x["finite"] == x["non_null"]}
    wanted: dict[str, list[float]] = {}
    for n, x in numeric.items():
        ps = [0.25, 0.75] if x["finite"] >= LEAST_VALUES else []
        if n in clean and x["finite"]:
            ps = ps + [0.5]
        if ps:
            wanted[n] = [p * (x["finite"] - 1) for p in ps]

    # Where infinities or NaN are present the median ranks all non-null values:
    # -inf first, then the finite values, then +inf, then NaN.
    shifted = {}
    for n, x in numeric.items():
        if n in clean:
            continue
        position = 0.5 * (x["non_null"] - 1) - x["lowest"]
        if 0 <= position <= x["finite"] - 1:
            shifted[n] = [position]
            wanted.setdefault(n, []).append(position)

    # the counts of a column of very many values would have to be sorted; the search in its rows sorts nothing
    counted = {n: ps for n, ps in wanted.items() if values and values.distinct.get(n, math.inf) <= IN_ONE_TASK}
    known = values.at_positions(counted) if counted else {}
    others = {n: ps for n, ps in wanted.items() if n not in counted}
    known |= values_at_positions(frame, others, counts, {n: x["distinct"] for n, x in numeric.items()}, small, sample)

    for n, x in numeric.items():
        at = lambda p: known.get((n, p * (x["finite"] - 1)))  # noqa: B023, E731
        x["q1"], x["q3"] = (at(0.25), at(0.75)) if x["finite"] >= LEAST_VALUES else (None, None)
        x["median"] = known[(n, shifted[n][0])] if n in shifted else at(0.5) if n in clean else None


def _sketch(frame: DataFrame, numeric: dict) -> None:
    """Quartiles and medians from sketches; a column with infinities or NaN has no median here."""
    wanted = {n: [0.25, 0.5, 0.75] for n, x in numeric.items() if x["finite"]}
    found = {}
    for part in _cut(list(wanted), NUMERIC_PER_SCAN * SCANS_PER_JOB):
        found |= sketch_quantiles(frame, {n: wanted[n] for n in part})
    for n, x in numeric.items():
        enough = x["finite"] >= LEAST_VALUES
        x["q1"], x["q3"] = (found.get((n, 0.25)), found.get((n, 0.75))) if enough else (None, None)
        x["median"] = found.get((n, 0.5)) if x["finite"] == x["non_null"] else None


def _measure_shape(frame: DataFrame, numeric: dict) -> None:
    for x in numeric.values():
        n, var = x["finite"], x.pop("var")
        x["finite_std"] = math.sqrt(var) if var is not None else None
        all_finite = n == x["non_null"]
        x["mean"] = x["finite_mean"] if all_finite else None
        x["std"] = math.sqrt(var * n / (n - 1)) if all_finite and n > 1 else None

    shaped = [x for x in numeric.values() if x["finite"] >= LEAST_VALUES]
    for x in shaped:
        x["outliers_iqr"] = x["outliers_z"] = 0
    shaped = [x for x in shaped if x["finite_std"] > 0]
    for job in _cut(_cut(shaped, NUMERIC_PER_SCAN), SCANS_PER_JOB):
        groups = [[m for x in part for m in _shape_of(x)] for part in job]
        for part, values in zip(job, measure(frame, groups)):
            row = iter(values)
            for x in part:
                x["skewness"], x["kurtosis"] = next(row), next(row)
                x["outliers_iqr"], x["outliers_z"] = int(next(row)), int(next(row))


def _shape_of(x: dict) -> list:
    c = col(x["column"])
    z = (c - x["finite_mean"]) / x["finite_std"]
    fence = FENCE_WIDTH * (x["q3"] - x["q1"])
    outside = (c < x["q1"] - fence) | (c > x["q3"] + fence)
    return [
        F.avg(z * z * z),
        F.avg(z * z * z * z) - 3.0,
        F.count_if(outside) if fence > 0 else F.count_if(F.lit(False)),
        F.count_if(F.abs(z) >= Z_LIMIT),
    ]


def _as_profile(df: DataFrame, facts: list[dict]) -> DataFrame:
    records = [tuple(x.get(f.name) for f in _FACTS.fields) for x in facts]
    base = local_rows(df.sparkSession, records, _FACTS)
    c = F.col
    return (
        base.withColumn("nulls", c("rows") - c("non_null"))
        .withColumn("null_pct", share(c("nulls"), c("rows")))
        .withColumn("distinct_pct", F.when(c("distinct").isNotNull(), share(c("distinct"), c("rows"))))
        .withColumn("iqr", c("q3") - c("q1"))
        .withColumn("analytic_type", analytic_type(c("kind"), c("distinct"), c("rows")))
        .withColumn("chart", suggested_chart(c("analytic_type"), c("distinct"), c("rows")))
        .select("ordinal", *PROFILE_COLUMNS, *MOMENT_COLUMNS)
    )
