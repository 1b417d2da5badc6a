"""Many whole-table measures in one job.

A single aggregate over hundreds of expressions compiles to methods too large for the JIT. The
measures are therefore split into groups that read different columns; the groups run side by side
in one job and together read every column once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measure(df: DataFrame, groups: list[list[Column]], kind: str = "double") -> list[list[float | None]]:
    """Value of every aggregate, group by group, as doubles or values of another type.

    Counts stay exact as doubles up to 2**53 rows.
    """
    parts = [
        df.agg(*[m.cast(kind).alias(f"m{j}") for j, m in enumerate(group)]).select(
            F.lit(i).alias("k"), F.array(*[f"m{j}" for j in range(len(group))]).alias("ms")
        )
        for i, group in enumerate(groups)
        if group
    ]
    if not parts:
        return [[] for _ in groups]
    found = {r["k"]: r["ms"] for r in reduce(DataFrame.unionAll, parts).collect()}
    return [list(found.get(i, [])) for i in range(len(groups))]
