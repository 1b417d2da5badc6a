"""Derived test tables, each as a DataFrame and as the same SQL text.

The given tables have no gaps and hardly any correlated columns; these views add both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: strong, negative and near-duplicate pairs of columns."""
    c = F.col
    price, discount, tax = c("l_extendedprice"), c("l_discount"), c("l_tax")

    def total(x):
        return F.round(F.sum(x), 6)

    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_lines"),
            total(c("l_quantity")).alias("sum_qty"),
            total(price).alias("gross"),
            total(price * (1 - discount)).alias("net"),
            total(price * (1 - discount) * (1 + tax)).alias("charge"),
            F.round(F.avg(discount), 6).alias("avg_disc"),
            total(price * discount).alias("disc_amt"),
            F.round(-F.sum(price) / 1000, 6).alias("neg_gross"),
            F.max(tax).alias("max_tax"),
        )
    )


ORDER_WIDE_SQL = """
select l_orderkey, count(*)::int n_lines, round(sum(l_quantity), 6) sum_qty,
       round(sum(l_extendedprice), 6) gross,
       round(sum(l_extendedprice * (1 - l_discount)), 6) net,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) charge,
       round(avg(l_discount), 6) avg_disc, round(sum(l_extendedprice * l_discount), 6) disc_amt,
       round(-sum(l_extendedprice) / 1000, 6) neg_gross, max(l_tax) max_tax
from lineitem group by l_orderkey
"""
ORDER_WIDE_COLUMNS = [
    ("l_orderkey", "bigint"), ("n_lines", "int"), ("sum_qty", "double"), ("gross", "double"),
    ("net", "double"), ("charge", "double"), ("avg_disc", "double"), ("disc_amt", "double"),
    ("neg_gross", "double"), ("max_tax", "double"),
]


def doc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pieces(mark: str):
        text = F.col("text")
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit(""))) + 1).cast("bigint")

    return table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", pieces(" ").alias("words"), pieces("\n").alias("lines")
    )


DOC_SIZES_SQL = """
select doc_id, n_chars, len(string_split(text, ' ')) words, len(string_split(text, chr(10))) lines
from documents
"""


def events_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with gaps, constants, identifiers and free text."""
    k, value = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        k,
        value,
        F.when(k % 4 != 0, value).alias("value_25null"),
        F.when(k % 20 >= 11, value).alias("value_55null"),
        F.when(k % 4 == 0, value).alias("value_75null"),
        F.when(k % 100 < 3, value).alias("value_97null"),
        F.lit(7.0).alias("const_num"),
        (k % 2).cast("int").alias("flag_num"),
        (F.col("event_type") == "error").alias("is_error"),
        "ts",
        "event_type",
        "props",
        F.concat(F.lit("c"), k.cast("string")).alias("code_text"),
        F.concat(F.lit("m"), k.cast("string")).alias("memo"),
    )


EVENTS_SPARSE_SQL = """
select event_id, value,
       case when event_id % 4 <> 0 then value end value_25null,
       case when event_id % 20 >= 11 then value end value_55null,
       case when event_id % 4 = 0 then value end value_75null,
       case when event_id % 100 < 3 then value end value_97null,
       7.0::double const_num, (event_id % 2)::int flag_num, event_type = 'error' is_error,
       ts, event_type, props, 'c' || event_id code_text, 'm' || event_id memo
from events
"""
EVENTS_SPARSE_COLUMNS = [
    ("event_id", "bigint"), ("value", "double"), ("value_25null", "double"),
    ("value_55null", "double"), ("value_75null", "double"), ("value_97null", "double"),
    ("const_num", "double"), ("flag_num", "int"), ("is_error", "boolean"),
    ("ts", "timestamp_ntz"), ("event_type", "string"), ("props", "string"),
    ("code_text", "string"), ("memo", "string"),
]

LINEITEM_COLUMNS = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
    ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
    ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
CUSTOMER_COLUMNS = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
    ("c_acctbal", "double"), ("c_mktsegment", "string"),
]
ORDERS_COLUMNS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]
EVENTS_COLUMNS = [
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
    ("event_type", "string"), ("value", "double"), ("props", "string"),
]
