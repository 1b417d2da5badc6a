"""Row positions in a defined order, without gathering the rows anywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import INTEGRAL_TYPES, holds_map
from ..functions.scalars import col
from ..session import cut_lineage
from .quantiles import SAMPLE, SMALL, values_at_ranks


# Characters of a text that take part in a row order by rank search.
TEXT_KEY = 64
# Types whose values compare alike in Spark, Arrow and Python.
RANGE = "_range"
GROUP_TYPES = INTEGRAL_TYPES + (T.StringType, T.BooleanType, T.DateType)


def running_index(
    df: DataFrame,
    order_by: list[str],
    weight: str | None = None,
    group: list[str] | None = None,
    out: str = "start",
) -> DataFrame:
    """Adds the total weight (or row count) of all rows before this one within its group.

    The rows are range-partitioned by (group, order), so a group of any size spreads over as many
    partitions as it needs. Only one record per partition reaches the driver: what the last group
    of the partition has added up to. Rows of equal group and order may end up in any order among
    themselves, so the order should be unique.
    """
    group = group or []
    for n in group:
        if not isinstance(df.schema[n].dataType, GROUP_TYPES):
            raise ValueError(f"group by whole numbers, text, booleans or dates; cast {n!r} to one of them")
    keys = [col(n) for n in group + order_by]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The number of the range is written with the rows: later reads may cut, merge or unite partitions.
    ranged = cut_lineage(ordered.withColumn(RANGE, F.spark_partition_id()))
    carried = _carried_totals(ranged, weight, group)

    # Both functions travel to the workers as they are, without needing this package there.
    def group_changes(batch: pa.RecordBatch):
        """Rows at which a new group starts (the first row aside), first and last group."""
        if not group:
            return np.array([], dtype="int64"), (), ()
        values = [batch.column(batch.schema.get_field_index(n)) for n in group]
        differs = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for v in values:
            codes = v.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            differs |= codes[1:] != codes[:-1]
        first = tuple(v[0].as_py() for v in values)
        final = tuple(v[-1].as_py() for v in values)
        return np.flatnonzero(differs) + 1, first, final

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches cut where another range begins."""
        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index(RANGE)).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield batch.slice(a, b - a)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, total, fresh = None, None, 0, True
        for batch in pieces(batches):
            number = batch.column(batch.schema.get_field_index(RANGE))[0].as_py()
            batch = batch.drop_columns([RANGE])
            if number != now:
                now = number
                last, total = carried.get(number, (None, 0))
                fresh = last is None
            if weight is None:
                w = np.ones(batch.num_rows, dtype="int64")
            else:
                w = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False)
                w = w.astype("int64")
            before = np.cumsum(w) - w
            changes, first, final = group_changes(batch)
            if fresh or first != last:
                total = 0
            fresh = False
            base = np.zeros(batch.num_rows, dtype="int64")
            base[changes] = before[changes]
            start = before - np.maximum.accumulate(base)
            upto = int(changes[0]) if len(changes) else batch.num_rows
            start[:upto] += total
            total, last = int(start[-1] + w[-1]), final
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType(), False)])
    return ranged.mapInArrow(add, schema)


def _carried_totals(ranged: DataFrame, weight: str | None, group: list[str]) -> dict[int, tuple]:
    """Per partition: the group the partitions before it end in, and that group's total so far."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(col(weight))
    key = F.struct(*[col(n) for n in group]) if group else F.struct(F.lit(0).alias("all"))
    rows = (
        ranged.groupBy(F.col(RANGE).alias("p"), key.alias("g"))
        .agg(amount.cast("bigint").alias("w"))
        .groupBy("p")
        .agg(F.min("g").alias("first"), F.max("g").alias("last"), F.max_by("w", "g").alias("w"))
        .orderBy("p")
        .collect()
    )
    carried, last, total = {}, None, 0
    for r in rows:
        first, end = (tuple(r["first"]), tuple(r["last"])) if group else ((), ())
        if last is not None:
            carried[r["p"]] = (last, total)
        total = r["w"] + (total if last is not None and first == end and first == last else 0)
        last = end
    return carried


def systematic_sample(df: DataFrame, order_by: list[str], max_rows: int, unique: bool = False) -> DataFrame:
    """Every ``ceil(n / max_rows)``-th row in the given order, starting with the first.

    Adds ``position`` (in the whole table), ``sample_position`` and ``approx_row_number``. Only the
    order columns and a hash of the row are sorted; rows of equal order follow the hash, and exact
    copies are counted before they are sorted, so a heap of copies stays one record. The at most
    ``max_rows`` keys found are then looked up in the table. ``unique=True`` does without the hash
    when ``order_by`` is known to be unique.
    """
    keys = [f"_key{i}" for i in range(len(order_by) + (not unique))]
    values = [col(n) for n in order_by] + ([] if unique else [row_hash(df)])
    narrow = df.select(*[v.alias(k) for k, v in zip(keys, values)])
    if unique:
        counted = narrow.withColumn("_copies", F.lit(1).cast("bigint"))
    else:
        counted = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    total = df.count()
    step = max(1, math.ceil(total / max_rows))
    kept = math.ceil(total / step)
    placed = running_index(counted, keys, weight="_copies", out="_start")
    first = F.ceil(F.col("_start") / step).cast("bigint") * step
    end = F.col("_start") + F.col("_copies") - 1
    picks = F.when(first <= end, F.sequence(first, end, F.lit(step).cast("bigint")))
    picked = cut_lineage(placed.select(*keys, F.explode(picks).alias("position")))
    # at most max_rows keys, so both joins can send them to all tasks
    wanted = F.broadcast(picked.select(*[F.col(k).alias(f"_w{k}") for k in keys]).distinct())
    marked = df.select(F.struct(*[col(n) for n in df.columns]).alias("_row"), *[v.alias(k) for k, v in zip(keys, values)])
    met = marked.join(wanted, _same(keys, "_w"), "left_semi").groupBy(*keys).agg(F.first("_row").alias("_row"))
    placed_rows = met.join(F.broadcast(picked.select("position", *[F.col(k).alias(f"_p{k}") for k in keys])), _same(keys, "_p"))
    factor = math.ceil(total / kept) if kept else 1
    return placed_rows.select("_row.*", "position").select(
        "*",
        F.expr(f"position div {step}").alias("sample_position"),
        F.expr(f"(position div {step}) * {factor} + 1").alias("approx_row_number"),
    )


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def row_hash(df: DataFrame) -> Column:
    """A whole number from all columns, maps as sorted entries: an order for tables that name none."""
    def plain(f):
        return F.array_sort(F.map_entries(col(f.name))) if isinstance(f.dataType, T.MapType) else col(f.name)

    return F.xxhash64(*[plain(f) for f in df.schema.fields if isinstance(f.dataType, T.MapType) or not holds_map(f.dataType)])


def rows_at_positions(
    df: DataFrame,
    order_by: list[str],
    positions: list[int],
    small: int = SMALL,
    sample: int = SAMPLE,
) -> dict[int, dict]:
    """The rows at the given zero-based positions of the given order, as dictionaries.

    The value at each position is found by rank search, not by sorting. Rows with equal keys are
    taken apart by the next key and at last by a hash of the whole row, so only rows that are the
    same anyway can stand in for each other. Nulls come first, NaN last. Long texts are not
    searched value by value: their first ``TEXT_KEY`` characters decide, then the hash.
    """
    columns = df.columns
    keyed = df.withColumn("_hash", row_hash(df))
    for n in order_by:
        data_type = df.schema[n].dataType
        if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType, T.VariantType, T.BinaryType)):
            raise ValueError(f"rows can't be ordered by {n!r} of type {data_type.simpleString()}; leave order_by out to order by a hash of the row")
    order: list[str] = []
    for i, n in enumerate(order_by):
        data_type, c = df.schema[n].dataType, col(n)
        if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
            keys = [F.substring(c, 1, TEXT_KEY)]
        elif isinstance(data_type, (T.FloatType, T.DoubleType)):
            keys = [F.when(c.isNotNull(), F.isnan(c).cast("int")), F.when(F.isnan(c), 0.0).otherwise(c)]
        elif isinstance(data_type, T.TimestampType):
            keys = [F.unix_micros(c)]
        elif isinstance(data_type, T.TimestampNTZType):
            # by its own digits: the session's zone has no say
            seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            keys = [seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")]
        else:
            keys = [c]
        for j, k in enumerate(keys):
            order.append(f"_key_{i}_{j}")
            keyed = keyed.withColumn(order[-1], k)
    found: dict[int, dict] = {}
    _search_rows(keyed, [*order, "_hash"], {p: p for p in positions}, found, small, sample)
    return {p: {n: found[p][n] for n in columns} for p in positions}


def _search_rows(df, order_by, wanted, found, small, sample) -> None:
    """``wanted`` maps each overall position to its position inside ``df``."""
    key, rest = order_by[0], order_by[1:]
    data_type = df.schema[key].dataType
    base = df.agg(F.count(F.lit(1)).alias("n"), F.count(col(key)).alias("filled")).first()
    nulls = base["n"] - base["filled"]
    ranks = sorted({p - nulls for p in wanted.values() if p >= nulls})
    values = values_at_ranks(
        df.select(col(key)), [(key, r) for r in ranks], {key: base["filled"]}, None, small, sample
    )
    ends = sorted(set(values.values()))
    groups: list[tuple] = []
    if ends:
        c = col(key)
        measures = []
        for v in ends:
            same = F.lit(v).cast(data_type)
            measures += [F.count_if(c < same), F.count_if(c == same)]
        sizes = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)]).first()
        for i, v in enumerate(ends):
            inside = {
                p: q - nulls - sizes[2 * i]
                for p, q in wanted.items()
                if q >= nulls and values[(key, q - nulls)] == v
            }
            groups.append((c == F.lit(v).cast(data_type), sizes[2 * i + 1], inside))
    in_nulls = {p: q for p, q in wanted.items() if q < nulls}
    if in_nulls:
        groups.append((col(key).isNull(), nulls, in_nulls))

    single = [(condition, inside) for condition, size, inside in groups if size == 1 or not rest]
    for start in range(0, len(single), 20):
        part = single[start : start + 20]
        slot = F.lit(None).cast("int")
        for i, (condition, _) in enumerate(part):
            slot = F.when(condition, F.lit(i)).otherwise(slot)
        first_rows = (
            df.withColumn("_slot", slot)
            .where(F.col("_slot").isNotNull())
            .groupBy("_slot")
            .agg(F.first(F.struct(*[col(n) for n in df.columns])).alias("row"))
            .collect()
        )
        for r in first_rows:
            for p in part[r["_slot"]][1]:
                found[p] = r["row"].asDict()
    for condition, size, inside in groups:
        if size > 1 and rest:
            _search_rows(df.where(condition), rest, inside, found, small, sample)
