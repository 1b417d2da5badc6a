"""Pearson correlation of every column pair, each pair over the rows where both are finite.

Pairs of columns without gaps need one sum each, taken around the known means. Pairs with gaps are
measured over their common rows. Above ``WIDE`` columns all pairs come from one scan: every task
adds up matrix products of its batches and only the sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import numeric_names
from ..functions.scalars import as_double, clamp, col, correlation_strength, finite
from ..session import cut_lineage, local_rows
from .measures import measure

WIDE = 40
SUMS_PER_SCAN = 60
GAPPED_PER_SCAN = 12
SCANS_PER_JOB = 16
COLUMNS_PER_SCAN = 16
# Fixed value: the default limit of strong pairs.
STRONG = 0.70

PAIR_SCHEMA = "i int, j int, column_1 string, column_2 string, r double"


def pairwise_pearson(df: DataFrame, names: list[str] | None = None, method: str = "auto") -> DataFrame:
    """One row per pair i < j: positions, names and r (null when it is not defined)."""
    names = numeric_names(df) if names is None else names
    frame = df.select(*[finite(as_double(n)).alias(n) for n in names])
    moments = _moments(frame, names)
    if method == "auto":
        method = "pairs" if len(names) <= WIDE else "matrix"
    if method == "matrix":
        return _from_matrix(frame, names, moments)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    return _named(df, _measure_pairs(frame, names, moments, pairs), names)


def target_relevance(df: DataFrame, target: str, names: list[str] | None = None) -> DataFrame:
    """r of every other column with the target; the target name matches in any letter case."""
    names = numeric_names(df) if names is None else names
    place = find_column(names, target)
    if place is None:
        raise ValueError(f"no numeric column named {target!r}")
    frame = df.select(*[finite(as_double(n)).alias(n) for n in names])
    pairs = [(i, place) for i in range(len(names)) if names[i].lower() != names[place].lower()]
    found = _measure_pairs(frame, names, _moments(frame, names), pairs)
    rows = [(i, names[i], r) for (i, _), r in found.items() if r is not None]
    return local_rows(df.sparkSession, rows, "ordinal int, column string, r double")


def find_column(names: list[str], target: str) -> int | None:
    return next((i for i, n in enumerate(names) if n.lower() == target.strip().lower()), None)


def strong_pairs(pairs: DataFrame, threshold: float = STRONG) -> DataFrame:
    """Pairs with |r| at or above the threshold, strongest first."""
    # Rounded, so that equally strong pairs keep their column order whatever the summation order.
    order = Window.orderBy(F.desc(F.round("abs_r", 9)), "i", "j")
    return (
        pairs.withColumn("abs_r", F.abs("r"))
        .where(F.col("abs_r") >= threshold)
        .withColumn("strength", correlation_strength(F.col("r")))
        .withColumn("rank", F.row_number().over(order))
        .select("rank", "i", "j", "column_1", "column_2", "r", "abs_r", "strength")
    )


def correlation_matrix(strong: DataFrame, limit: int | None = None) -> DataFrame:
    """Square matrix, in long form, of the columns met along the strong pairs, all or the first ``limit``."""
    ends = strong.select(
        F.inline(
            F.array(
                F.struct((F.col("rank") * 2).alias("place"), F.col("column_1").alias("column")),
                F.struct((F.col("rank") * 2 + 1).alias("place"), F.col("column_2").alias("column")),
            )
        )
    )
    firsts = ends.groupBy("column").agg(F.min("place").alias("place")).orderBy("place")
    firsts = firsts if limit is None else firsts.limit(limit)
    axis = firsts.agg(F.array_sort(F.collect_list(F.struct("place", "column"))).alias("axis")).where(
        F.size("axis") >= 2
    )
    cells = (
        axis.select(F.posexplode("axis").alias("row", "a"), "axis")
        .select("row", "a", F.posexplode("axis").alias("col", "b"))
        .select("row", "col", F.col("a.column").alias("column_1"), F.col("b.column").alias("column_2"))
    )
    both_ways = strong.select("column_1", "column_2", "r").unionByName(
        strong.select(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"), "r")
    )
    value = F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.coalesce("r", F.lit(0.0)))
    return cells.join(both_ways, ["column_1", "column_2"], "left").select(
        "row", "col", "column_1", "column_2", value.alias("value")
    )


def _moments(frame: DataFrame, names: list[str]) -> dict[str, tuple]:
    """(rows, finite rows, mean, population variance) per column."""
    found: dict[str, tuple] = {}
    groups = [names[i : i + COLUMNS_PER_SCAN] for i in range(0, len(names), COLUMNS_PER_SCAN)]
    for start in range(0, len(groups), SCANS_PER_JOB):
        job = groups[start : start + SCANS_PER_JOB]
        values = measure(
            frame,
            [
                [F.count(F.lit(1))]
                + [m for n in g for m in (F.count(col(n)), F.avg(col(n)), F.var_pop(col(n)))]
                for g in job
            ],
        )
        for g, vs in zip(job, values):
            for k, n in enumerate(g):
                found[n] = (vs[0], *vs[1 + 3 * k : 4 + 3 * k])
    return found


def _measure_pairs(frame, names, moments, pairs) -> dict[tuple[int, int], float | None]:
    found: dict[tuple[int, int], float | None] = {p: None for p in pairs}
    gapless = {n for n, (rows, filled, _, _) in moments.items() if rows == filled}
    sums, gapped = [], []
    for i, j in pairs:
        if names[i] in gapless and names[j] in gapless:
            (rows, _, _, vi), (_, _, _, vj) = moments[names[i]], moments[names[j]]
            if rows >= 2 and vi > 0 and vj > 0:
                sums.append((i, j))
        else:
            gapped.append((i, j))

    def centred(i):
        return col(names[i]) - F.lit(moments[names[i]][2])

    for (i, j), (total,) in _in_scans(
        frame, sums, SUMS_PER_SCAN, 1, lambda i, j: [F.sum(centred(i) * centred(j))]
    ):
        rows, _, _, vi = moments[names[i]]
        vj = moments[names[j]][3]
        found[(i, j)] = _bounded(total / rows / (vi**0.5 * vj**0.5))
    for (i, j), (n, vi, vj, cov) in _in_scans(
        frame, gapped, GAPPED_PER_SCAN, 4, lambda i, j: _common_moments(names[i], names[j])
    ):
        if n >= 2 and vi > 0 and vj > 0:
            found[(i, j)] = _bounded(cov / (vi**0.5 * vj**0.5))
    return found


def _bounded(r: float) -> float:
    return min(max(r, -1.0), 1.0)


def _common_moments(x: str, y: str):
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return [F.count_if(both), F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)]


def _in_scans(frame, pairs, per_scan, width, measures_of):
    scans = [pairs[k : k + per_scan] for k in range(0, len(pairs), per_scan)]
    for start in range(0, len(scans), SCANS_PER_JOB):
        job = scans[start : start + SCANS_PER_JOB]
        values = measure(frame, [[m for p in scan for m in measures_of(*p)] for scan in job])
        for scan, vs in zip(job, values):
            for k, p in enumerate(scan):
                yield p, vs[k * width : (k + 1) * width]


def _named(df: DataFrame, found: dict, names: list[str]) -> DataFrame:
    rows = [(i, j, names[i], names[j], r) for (i, j), r in found.items()]
    return local_rows(df.sparkSession, rows, PAIR_SCHEMA)


# Below this share of the mean square a variance from sums is too close to cancellation.
DOUBTFUL = 1e-8


def _from_matrix(frame, names, moments) -> DataFrame:
    centres = np.array([moments[n][2] if moments[n][2] is not None else 0.0 for n in names])
    left, right = np.triu_indices(len(names), 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype="float64") - centres
            mask = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x, nan=0.0)
            sums = [mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x]
            total = sums if total is None else [a + b for a, b in zip(total, sums)]
        if total is None:
            return
        n, s, q, p = total
        yield pd.DataFrame(
            {
                "i": left, "j": right, "n": n[left, right],
                "si": s[left, right], "sj": s[right, left],
                "qi": q[left, right], "qj": q[right, left], "p": p[left, right],
            }
        )

    sums = (
        frame.mapInPandas(
            products,
            "i int, j int, n double, si double, sj double, qi double, qj double, p double",
        )
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")])
    )
    n = F.nullif("n", F.lit(0.0))
    vi, vj = F.col("qi") / n - (F.col("si") / n) ** 2, F.col("qj") / n - (F.col("sj") / n) ** 2
    cov = F.col("p") / n - F.col("si") / n * F.col("sj") / n
    doubtful = (vi <= F.col("qi") / n * DOUBTFUL) | (vj <= F.col("qj") / n * DOUBTFUL)
    labels = F.array(*map(F.lit, names))
    pairs = cut_lineage(
        sums.select(
            "i", "j",
            F.get(labels, F.col("i")).alias("column_1"),
            F.get(labels, F.col("j")).alias("column_2"),
            F.when((F.col("n") >= 2) & (vi > 0) & (vj > 0), clamp(cov / F.nullif(F.sqrt(vi) * F.sqrt(vj), F.lit(0.0)), -1.0, 1.0)).alias("r"),
            ((F.col("n") >= 2) & F.coalesce(doubtful, F.lit(False))).alias("doubtful"),
        )
    )
    again = [(r["i"], r["j"]) for r in pairs.where("doubtful").select("i", "j").collect()]
    if not again:
        return pairs.drop("doubtful")
    # Nearly constant over the common rows: measure these pairs with running means instead.
    exact = {}
    for p, (rows, a, b, c) in _in_scans(
        frame, again, GAPPED_PER_SCAN, 4, lambda i, j: _common_moments(names[i], names[j])
    ):
        exact[p] = _bounded(c / (a**0.5 * b**0.5)) if rows >= 2 and a > 0 and b > 0 else None
    return pairs.where(~F.col("doubtful")).drop("doubtful").unionByName(_named(frame, exact, names))
