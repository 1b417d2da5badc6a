"""Parquet tables and their schema summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_size(df: DataFrame) -> DataFrame:
    """One row: row count and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def schema_summary(df: DataFrame) -> DataFrame:
    """One row per column: position, name, physical type, null count, row count."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)],
    )
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("physical_type"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            F.col("rows"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*entries)))
