"""Exact quantiles of many numeric columns without sorting the table.

A column with up to ``SMALL`` different values is ranked from its value counts: equal values
collapse before the shuffle, whatever the row count. Above that the rank is closed in on: a bounded
sample proposes pivots around the wanted ranks, one scan counts the rows between them, and the
search goes on inside. The counts decide, the sample only guesses, so the answer is exact; each
round shrinks the interval about a hundredfold and shuffles a few numbers per task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col

SMALL = 200_000
SAMPLE = 100_000
LEAST_SAMPLE = 20_000
COLUMNS_PER_JOB = 24
# Share of a column's rows that a sketched quantile's rank may be off.
SKETCH_ERROR = 0.0005


def exact_quantiles(
    frame: DataFrame,
    probabilities: dict[str, list[float]],
    counts: dict[str, int],
    distinct: dict[str, int] | None = None,
    small: int = SMALL,
    sample: int = SAMPLE,
) -> dict[tuple[str, float], float]:
    """Linear-interpolation quantiles at position ``p * (n - 1)``.

    ``frame`` holds double columns with only finite values and nulls, ``counts`` their non-null
    row counts and ``distinct``, where known, their distinct counts. Columns without values are
    left out of the answer.
    """
    places = {
        (n, p): p * (counts[n] - 1) for n, ps in probabilities.items() for p in ps if counts[n]
    }
    positions: dict[str, list[float]] = {}
    for (n, _), place in places.items():
        positions.setdefault(n, []).append(place)
    found = values_at_positions(frame, positions, counts, distinct, small, sample)
    return {key: found[(key[0], place)] for key, place in places.items()}


def values_at_positions(
    frame: DataFrame,
    positions: dict[str, list[float]],
    counts: dict[str, int],
    distinct: dict[str, int] | None = None,
    small: int = SMALL,
    sample: int = SAMPLE,
) -> dict[tuple[str, float], float]:
    """Interpolated values at fractional positions of the sorted non-null values."""
    ranks = {(n, r) for n, ps in positions.items() for r in ranks_around(ps)}
    return interpolated(positions, values_at_ranks(frame, sorted(ranks), counts, distinct, small, sample))


def sketch_quantiles(frame: DataFrame, probabilities: dict[str, list[float]], error: float = SKETCH_ERROR) -> dict[tuple[str, float], float]:
    """Values of the columns near the wanted quantiles, from mergeable sketches in one scan of all columns.

    The answer is a value of the column whose rank lies within ``error`` times the column's rows of
    the wanted one; nothing is interpolated and nothing but sketches is shuffled. Columns without
    values are left out.
    """
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    accuracy = math.ceil(1 / error)
    wanted = {n: ps for n, ps in probabilities.items() if ps}
    if not wanted:
        return {}
    row = frame.agg(*[F.percentile_approx(col(n), ps, accuracy).alias(f"q{i}") for i, (n, ps) in enumerate(wanted.items())]).first()
    return {(n, p): v for i, (n, ps) in enumerate(wanted.items()) for p, v in zip(ps, row[i] or [])}


def rank_distances(frame: DataFrame, values: dict[tuple[str, float], float]) -> dict[tuple[str, float], float]:
    """How far the ranks of ``values`` are from the wanted ones, as a share of the column's rows.

    A value that stands at several ranks is as far as its nearest one.
    """
    if not values:
        return {}
    counts = [m for (n, _), v in values.items() for m in (F.count(col(n)), F.count_if(col(n) < v), F.count_if(col(n) <= v))]
    row = iter(frame.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first())
    answer = {}
    for n, p in values:
        rows, below, upto = next(row), next(row), next(row)
        answer[(n, p)] = max(below - p * rows, p * rows - upto, 0) / rows
    return answer


def ranks_around(positions: list[float]) -> list[int]:
    """The whole ranks that fractional positions lie between."""
    return sorted({r for p in positions for r in (math.floor(p), math.ceil(p))})


def interpolated(positions: dict[str, list[float]], known: dict[tuple[str, int], float]) -> dict[tuple[str, float], float]:
    answer = {}
    for n, ps in positions.items():
        for pos in ps:
            low, high = known[(n, math.floor(pos))], known[(n, math.ceil(pos))]
            weight = pos - math.floor(pos)
            answer[(n, pos)] = low if low == high else low * (1.0 - weight) + high * weight
    return answer


class _Search:
    """Ranks of one column that fall into one open interval (low, high)."""

    def __init__(self, name: str, ranks: list[int], low: float, high: float, below: int, inside: int):
        self.name, self.ranks = name, ranks
        self.low, self.high = low, high
        self.below, self.inside = below, inside

    def condition(self) -> Column:
        c = col(self.name)
        inside = c.isNotNull()
        if self.low != -math.inf:
            inside = inside & (c > self.low)
        if self.high != math.inf:
            inside = inside & (c < self.high)
        return inside


def values_at_ranks(
    frame: DataFrame,
    targets: list[tuple[str, int]],
    counts: dict[str, int],
    distinct: dict[str, int] | None = None,
    small: int = SMALL,
    sample: int = SAMPLE,
) -> dict[tuple[str, int], float]:
    """Value at each zero-based rank of the sorted non-null values of its column."""
    by_name: dict[str, list[int]] = {}
    for n, r in targets:
        if not 0 <= r < counts[n]:
            raise ValueError(f"rank {r} of {n!r} is outside its {counts[n]} values")
        by_name.setdefault(n, []).append(r)
    distinct = distinct or {}
    known: dict[tuple[str, int], float] = {}
    names = list(by_name)
    for start in range(0, len(names), COLUMNS_PER_JOB):
        part = names[start : start + COLUMNS_PER_JOB]
        searches = [
            _Search(n, sorted(set(by_name[n])), -math.inf, math.inf, 0, counts[n]) for n in part
        ]
        seed = 0
        few = [s for s in searches if distinct.get(s.name, s.inside) <= small]
        searches = [s for s in searches if s not in few]
        while any(s.inside > small for s in searches):
            wide = [s for s in searches if s.inside > small]
            few += [s for s in searches if s.inside <= small]
            searches = _narrow(frame, wide, small, sample, seed, known)
            seed += 1
        searches = few + searches
        _pick(frame, searches, known)
    return known


def _stack(frame: DataFrame, labelled: list[tuple[str, Column]]) -> DataFrame:
    """Rows (k, v) of several columns, each column read by its own scan."""
    parts = [frame.select(label.alias("k"), col(n).alias("v")) for n, label in labelled]
    return reduce(DataFrame.unionAll, parts).where(F.col("k").isNotNull())


def _narrow(frame, searches, small, sample, seed, known) -> list[_Search]:
    """Split every interval at sampled pivots and keep the pieces that hold wanted ranks."""
    pivots = _propose(frame, searches, small, sample, seed)
    labelled = []
    for i, s in enumerate(searches):
        # Slots 0, 2, 4 ... lie between the pivots, slots 1, 3, 5 ... are the pivots themselves.
        width = 2 * len(pivots[i]) + 1
        c = col(s.name)
        slot = F.lit(width - 1)
        for j in range(len(pivots[i]) - 1, -1, -1):
            pivot = F.lit(pivots[i][j])
            slot = F.when(c < pivot, 2 * j).when(c == pivot, 2 * j + 1).otherwise(slot)
        labelled.append((s.name, F.when(s.condition(), slot + i * 1000)))
    sizes = {
        r["k"]: r["n"]
        for r in _stack(frame, labelled).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    kept = []
    for i, s in enumerate(searches):
        edges = [s.low, *pivots[i], s.high]
        below = s.below
        for slot in range(2 * len(pivots[i]) + 1):
            size = sizes.get(i * 1000 + slot, 0)
            ranks = [r for r in s.ranks if below <= r < below + size]
            if ranks and slot % 2:
                known.update({(s.name, r): edges[slot // 2 + 1] for r in ranks})
            elif ranks:
                kept.append(
                    _Search(s.name, ranks, edges[slot // 2], edges[slot // 2 + 1], below, size)
                )
            below += size
    return kept


def _propose(frame, searches, small, sample, seed) -> list[list[float]]:
    """Pivots around the wanted ranks, from samples whose size does not grow with the table."""
    parts, fractions = [], []
    for i, s in enumerate(searches):
        # Large enough to leave about SMALL values between the pivots, within the bounds.
        size = min(sample, max(LEAST_SAMPLE, int((8 * s.inside / small) ** 2)), s.inside)
        near = set()
        for r in s.ranks:
            q = (r - s.below + 0.5) / s.inside
            margin = 4.0 * math.sqrt(q * (1.0 - q) / size) + 2.0 / size
            near |= {max(q - margin, 0.0), min(q + margin, 1.0)}
        fractions.append(_thin(sorted(near)))
        parts.append(
            frame.where(s.condition())
            .select(F.lit(i).alias("k"), col(s.name).alias("v"))
            .sample(min(1.0, size / s.inside), seed * 1000 + i)
        )
    drawn = reduce(DataFrame.unionAll, parts).groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    wanted = F.array().cast("array<double>")
    for i, qs in enumerate(fractions):
        wanted = F.when(F.col("k") == i, F.array(*map(F.lit, qs))).otherwise(wanted)
    rows = drawn.select(
        "k",
        F.transform(
            wanted, lambda q: F.get("vs", F.least(F.floor(q * F.size("vs")), F.size("vs") - 1).cast("int"))
        ).alias("ps"),
    ).collect()
    found = {r["k"]: sorted(set(r["ps"])) for r in rows}
    if any(i not in found for i in range(len(searches))):
        return _propose(frame, searches, small, sample, seed + 7)
    return [found[i] for i in range(len(searches))]


def _thin(fractions: list[float]) -> list[float]:
    """Neighbouring ranks ask for nearly the same pivots; one of each is enough."""
    kept: list[float] = []
    for q in fractions:
        if not kept or q - kept[-1] > 1e-4:
            kept.append(q)
    return kept


def _pick(frame: DataFrame, searches: list[_Search], known: dict) -> None:
    """Rank the few values left inside each interval."""
    if not searches:
        return
    by_name: dict[str, Column] = {}
    wanted = F.array().cast("array<bigint>")
    for i, s in enumerate(searches):
        label = by_name.get(s.name, F.lit(None).cast("int"))
        by_name[s.name] = F.when(s.condition(), F.lit(i)).otherwise(label)
        offsets = F.array(*[F.lit(r - s.below).cast("bigint") for r in s.ranks])
        wanted = F.when(F.col("k") == i, offsets).otherwise(wanted)
    # At most SMALL values per interval remain here, so one task ranks an interval easily.
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    hits = (
        _stack(frame, list(by_name.items()))
        .groupBy("k", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", upto)
        .withColumn("offset", F.explode(wanted))
        .where((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("n")))
        .select("k", "offset", "v")
        .collect()
    )
    for h in hits:
        s = searches[h["k"]]
        known[(s.name, s.below + h["offset"])] = h["v"]
