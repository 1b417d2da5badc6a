"""Value counts of the numeric columns of a table, written once: distinct counts, quantiles and ranks come from them.

Whole-number and floating columns are stacked to (id, value) and counted, so equal values collapse
before the one shuffle of values. A distinct count is the number of a column's rows here; a rank is found by running
totals of the counts, in ranges of the values where a column has too many of them for one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import FLOATING_TYPES, INTEGRAL_TYPES, distinct_family
from ..functions.scalars import col, is_finite
from ..session import discard, materialize
from .ordering import running_index
from .quantiles import interpolated, ranks_around

COLUMNS_PER_STACK = 100
# Different values of a column that one task sorts and adds up; a sort of so many short rows spills if it must.
IN_ONE_TASK = 2_000_000


@dataclass
class ValueCounts:
    """``frame`` holds (id, whole, real, n), ``ids`` the number of each column; nulls are no values."""

    frame: DataFrame
    ids: dict[str, int]
    distinct: dict[str, int]

    def of(self, names: list[str]) -> DataFrame:
        """(id, v, n) of some columns, finite values only, as doubles."""
        v = F.coalesce(F.col("whole").cast("double"), F.col("real"))
        wanted = F.col("id").isin([self.ids[n] for n in names])
        return self.frame.where(wanted & is_finite(v)).select("id", v.alias("v"), "n")

    def at_ranks(self, ranks: dict[str, list[int]], small: int = IN_ONE_TASK) -> dict[tuple[str, int], float]:
        """The value at each zero-based rank of the sorted finite values of its column.

        Columns of up to ``small`` different values add up their counts in a task each; the values of
        others are spread over ranges.
        """
        few = [n for n in ranks if self.distinct[n] <= small]
        many = [n for n in ranks if n not in few]
        found = []
        if few:
            # whole numbers beyond 2**53 may be equal as doubles, so rows are added up, not peers
            upto = Window.partitionBy("id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            before = F.sum("n").over(upto) - F.col("n")
            found.append(self.of(few).withColumn("start", before))
        if many:
            found.append(running_index(self.of(many), ["v"], weight="n", group=["id"], out="start"))
        names = {self.ids[n]: n for n in ranks}
        known = {}
        for frame in found:
            wanted = F.array().cast("array<bigint>")
            for n, rs in ranks.items():
                wanted = F.when(F.col("id") == self.ids[n], F.array(*[F.lit(r).cast("bigint") for r in sorted(set(rs))])).otherwise(wanted)
            inside = F.filter(wanted, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
            for r in frame.select("id", "v", F.explode(inside).alias("rank")).collect():
                known[(names[r["id"]], r["rank"])] = r["v"]
        return known

    def at_positions(self, positions: dict[str, list[float]], small: int = IN_ONE_TASK) -> dict[tuple[str, float], float]:
        """Interpolated values at fractional positions of the sorted finite values."""
        positions = {n: ps for n, ps in positions.items() if ps}
        known = self.at_ranks({n: ranks_around(ps) for n, ps in positions.items()}, small) if positions else {}
        return interpolated(positions, known)

    def quantiles(self, probabilities: dict[str, list[float]], counts: dict[str, int], small: int = IN_ONE_TASK) -> dict[tuple[str, float], float]:
        """Linear interpolation at position ``p * (n - 1)`` of a column's ``counts`` finite values."""
        places = {(n, p): p * (counts[n] - 1) for n, ps in probabilities.items() for p in ps if counts[n]}
        asked: dict[str, list[float]] = {}
        for (n, _), place in places.items():
            asked.setdefault(n, []).append(place)
        found = self.at_positions(asked, small)
        return {key: found[(key[0], place)] for key, place in places.items()}

    def release(self) -> None:
        """Remove the frame."""
        discard(self.frame)


def countable(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGRAL_TYPES + FLOATING_TYPES)


def value_counts(df: DataFrame, names: list[str]) -> ValueCounts:
    """Counts of the values of whole-number and floating columns. NaN is one value, as are 0.0 and -0.0."""
    types = {f.name: f.dataType for f in df.schema.fields}
    ids = {n: i for i, n in enumerate(names)}
    stacks = []
    for family, empty in (("bigint", "real"), ("double", "whole")):
        members = [n for n in names if distinct_family(types[n]) == family]
        for start in range(0, len(members), COLUMNS_PER_STACK):
            part = members[start : start + COLUMNS_PER_STACK]
            keys = [col(n).cast(family).alias(str(ids[n])) for n in part]
            stacked = df.select(*keys).unpivot([], [str(ids[n]) for n in part], "id", "v").where("v is not null")
            values = {"whole": F.col("v").cast("bigint"), "real": F.col("v").cast("double")}
            values[empty] = F.lit(None).cast("double" if empty == "real" else "bigint")
            stacks.append(stacked.select(F.col("id").cast("int").alias("id"), *[c.alias(k) for k, c in values.items()]))
    frame = materialize(reduce(DataFrame.unionAll, stacks).groupBy("id", "whole", "real").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["id"]: r["count"] for r in frame.groupBy("id").count().collect()}
    return ValueCounts(frame, ids, {n: sizes.get(i, 0) for n, i in ids.items()})
