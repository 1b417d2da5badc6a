"""Exact distinct counts for many columns at once.

Columns of one type family are stacked into (column, value) rows and de-duplicated. The stacked
rows are narrow, a value that fills a third of the table collapses before the shuffle, and only
one count per column leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import distinct_family, distinct_key

COLUMNS_PER_STACK = 100


def exact_distinct(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Distinct non-null values per column; columns without equality (maps) are left out."""
    types = {f.name: f.dataType for f in df.schema.fields}
    families: dict[str, list[str]] = {}
    for name in names:
        family = distinct_family(types[name])
        if family is not None:
            families.setdefault(family, []).append(name)

    counted = None
    for members in families.values():
        for start in range(0, len(members), COLUMNS_PER_STACK):
            part = _stacked_counts(df, members[start : start + COLUMNS_PER_STACK], types, names)
            counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return {}
    found = {r["id"]: r["n"] for r in counted.collect()}
    return {
        name: found.get(str(i), 0)
        for i, name in enumerate(names)
        if distinct_family(types[name]) is not None
    }


def _stacked_counts(df, members, types, names):
    keys = [distinct_key(n, types[n]).alias(str(names.index(n))) for n in members]
    stacked = df.select(*keys).unpivot([], [str(names.index(n)) for n in members], "id", "v")
    return (
        stacked.where(F.col("v").isNotNull())
        .distinct()
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def approximate_distinct(df: DataFrame, names: list[str], rows: int) -> dict[str, int]:
    """Sketch-based counts, counted exactly wherever a rule threshold is near.

    A column whose estimate lies within 10 % of a threshold used by the column rules is counted
    again exactly, so the rules decide as they would on exact counts.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    usable = [n for n in names if distinct_family(types[n]) is not None]
    if not usable:
        return {}
    row = df.agg(
        *[
            F.approx_count_distinct(distinct_key(n, types[n]), 0.01).alias(str(i))
            for i, n in enumerate(usable)
        ]
    ).first()
    estimates = {n: row[i] for i, n in enumerate(usable)}
    # Counts and shares of rows at which a column rule changes its answer.
    thresholds = [1, 2, 5, 20, 50, 1000] + [rows * p for p in (0.2, 0.5, 0.7, 0.8, 0.95, 1.0)]
    close = [
        n
        for n, e in estimates.items()
        if any(abs(e - t) <= max(0.10 * t, 2) for t in thresholds)
    ]
    if close:
        estimates.update(exact_distinct(df.select(*[df[_quoted(n)] for n in close]), close))
    return estimates


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
