"""Column kinds: which Spark types count as what, and the chart that suits each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import as_double, col

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# A column is a category up to this share or this count of distinct values.
CATEGORY_SHARE = 0.20
CATEGORY_COUNT = 50
BARS_COUNT = 20


def is_numeric(data_type: T.DataType, include_decimal: bool = False) -> bool:
    if isinstance(data_type, T.DecimalType):
        return include_decimal
    return isinstance(data_type, INTEGRAL_TYPES + FLOATING_TYPES)


def numeric_names(df: DataFrame, include_decimal: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType, include_decimal)]


def numeric_columns(df: DataFrame, include_decimal: bool = False) -> DataFrame:
    """Only the numeric columns, each cast to double."""
    return df.select(*[as_double(n).alias(n) for n in numeric_names(df, include_decimal)])


def schema_kind(data_type: T.DataType, include_decimal: bool = False) -> str:
    """Kind known from the type alone; ``other`` needs the distinct count."""
    if is_numeric(data_type, include_decimal):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, TEMPORAL_TYPES):
        return "temporal"
    return "other"


def analytic_type(kind: Column, distinct: Column, rows: Column) -> Column:
    ratio = (
        F.when(rows <= 0, 0.0)
        .when(distinct.isNull(), 1.0)
        .otherwise(distinct / F.nullif(rows, F.lit(0)))
    )
    few = F.coalesce(distinct <= CATEGORY_COUNT, F.lit(False))
    return (
        F.when(kind != "other", kind)
        .when((ratio <= CATEGORY_SHARE) | few, "categorical")
        .otherwise("text_id")
    )


def suggested_chart(analytic: Column, distinct: Column, rows: Column) -> Column:
    return (
        F.when(analytic == "numeric", "histogram_boxplot")
        .when(analytic == "temporal", "time_line")
        .when(analytic == "boolean", "bars")
        .when(
            analytic == "categorical",
            F.when(distinct <= BARS_COUNT, "bars").otherwise("bars_top20"),
        )
        .when(F.coalesce(distinct, rows) == rows, "skip_possible_id")
        .otherwise("frequency_top20")
    )


def holds_map(data_type: T.DataType) -> bool:
    """Maps have no equality in Spark, so columns holding one get no distinct count."""
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(holds_map(f.dataType) for f in data_type.fields)
    return isinstance(data_type, T.VariantType)


def distinct_family(data_type: T.DataType) -> str | None:
    """Columns of one family can share one long (column, value) shuffle."""
    if holds_map(data_type):
        return None
    if isinstance(data_type, INTEGRAL_TYPES):
        return "bigint"
    if isinstance(data_type, FLOATING_TYPES):
        return "double"
    if isinstance(data_type, TEMPORAL_TYPES + (T.BooleanType,)):
        return data_type.simpleString()
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        # compared by their own values, so nothing is lost in a printed form
        return f"nested {data_type.json()}"
    return "string"


# Keys up to this many characters travel as they are, longer ones as their 64-character SHA-256,
# so whole documents are not shuffled just to be counted.
SHORT_KEY = 63


def distinct_key(name: str, data_type: T.DataType) -> Column:
    """Value that is equal exactly when the column value is equal, cheap to shuffle."""
    family = distinct_family(data_type)
    c = col(name)
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return c
    if family != "string":
        return c.cast(family)
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        text = c
    elif isinstance(data_type, T.BinaryType):
        text = F.hex(c)
    else:
        text = c.cast("string")
    return F.when(F.length(text) <= SHORT_KEY, text).otherwise(F.sha2(text, 256))
