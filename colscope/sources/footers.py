"""Row counts, null counts and whole-number ranges from Parquet footers, without reading a column.

Spark's second-version Parquet source answers such aggregates from the statistics in the file
footers. A session of its own switches that on, so that the caller's settings stay as they are.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import INTEGRAL_TYPES
from ..functions.scalars import col
from ..session import local_rows

FACTS = "ordinal int, column string, physical_type string, nulls bigint, rows bigint, least bigint, most bigint"
NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
# What the source says when a file was written without statistics.
NO_STATISTICS = "spark.sql.parquet.aggregatePushdown"


def footer_session(spark: SparkSession) -> SparkSession:
    """A session on the same context whose Parquet scans answer counts and ranges from footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def row_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: all rows, and the non-null rows of the columns, by their position."""
    places = [i for i, f in enumerate(df.schema.fields) if f.name in names]
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(df.columns[i])).alias(f"n{i}") for i in places])


def ranges(df: DataFrame, places: list[int]) -> DataFrame:
    """One row: least and greatest value of the columns at these positions."""
    return df.agg(*[m(col(df.columns[i])).alias(f"{name}{i}") for i in places for name, m in (("low", F.min), ("high", F.max))])


def pushed_aggregation(df: DataFrame) -> bool:
    """Whether the plan of an aggregate takes its answer from footers."""
    plan = df._jdf.queryExecution().toString()
    return bool(re.search(r"PushedAggregation: \[[^\]]", plan))


def table_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per column of a Parquet table: position, name, type, null count, row count, whole-number range.

    Columns of plain types are answered from footers, the others (nested ones, whose statistics don't
    tell an empty value from none, and partition columns) by a scan of these columns alone. Where a
    file lacks the statistics, or has no value for a range, the columns in question are scanned.
    Least and most value are null for other types and for columns without values.
    """
    df, footers = spark.read.parquet(path), footer_session(spark).read.parquet(path)
    fields = df.schema.fields
    in_folders = _partition_columns(df)
    plain = [f.name for f in fields if not isinstance(f.dataType, NESTED) and f.name not in in_folders]
    found = _answered(row_counts(footers, plain), row_counts(df, plain)) if plain else {}
    # counts of no footers at all come out as null
    found = {name: n or 0 for name, n in found.items()}
    others = [f.name for f in fields if f.name not in plain]
    if others:
        found |= row_counts(df, others).first().asDict()
    whole = [i for i, f in enumerate(fields) if isinstance(f.dataType, INTEGRAL_TYPES) and found[f"n{i}"]]
    inside = [i for i in whole if fields[i].name in plain]
    if inside:
        found |= _answered(ranges(footers, inside), ranges(df, inside))
    if outside := [i for i in whole if i not in inside]:
        found |= ranges(df, outside).first().asDict()
    records = [
        (i, f.name, f.dataType.simpleString(), found["rows"] - found[f"n{i}"], found["rows"], found.get(f"low{i}"), found.get(f"high{i}"))
        for i, f in enumerate(fields)
    ]
    return local_rows(spark, records, FACTS)


def _answered(by_footers: DataFrame, by_scan: DataFrame) -> dict:
    try:
        return by_footers.first().asDict()
    except (PySparkException, Py4JJavaError) as e:
        if NO_STATISTICS not in str(e) + _causes(e):
            raise
        return by_scan.first().asDict()


def _causes(e: Exception) -> str:
    """The messages of a Java exception and of what caused it."""
    said, at = [], getattr(e, "java_exception", None)
    while at is not None and len(said) < 10:
        said.append(str(at.getMessage()))
        at = at.getCause()
    return "\n".join(said)


def _partition_columns(df: DataFrame) -> set[str]:
    """Columns whose values stand in folder names: footers know nothing of them."""
    files = df.inputFiles()[:1]
    return {n for n in df.columns if files and f"/{n}=" in files[0]}
