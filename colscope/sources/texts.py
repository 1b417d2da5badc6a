"""Bulk work on document texts: sizes, one file per document, ordered merging of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from ..operators.ordering import running_index

SEPARATOR = "\n"
# Bytes of merged text per output row; a group beyond it continues in further rows.
CHUNK_BYTES = 64 * 1024 * 1024


def line_count(text: Column) -> Column:
    """Lines of a text: a line break at the end does not start another line."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = (F.length(text) > 0) & ~F.endswith(text, F.lit("\n"))
    return (breaks + open_end.cast("int")).cast("bigint")


def text_stats(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return df.select(
        *[col(k) for k in keys],
        line_count(col(text)).alias("lines"),
        F.char_length(col(text)).cast("bigint").alias("chars"),
    )


def text_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars")
    )


def stem_of(path: Column) -> Column:
    """File name without folders and without the last extension."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(name.rlike("^.+\\.[^.]*$"), F.regexp_replace(name, "\\.[^.]*$", "")).otherwise(name)


def titled_texts(df: DataFrame, text: str, source: str | None = None, name: str | None = None) -> DataFrame:
    """(document, text): titles are ``<stem of the source>.txt`` unless a name is given.

    Documents of one title are told apart by a number, ``a.txt``, ``a (2).txt`` and so on, in the
    order of their sources and texts.
    """
    title = col(name) if name else F.concat(stem_of(col(source)), F.lit(".txt"))
    order = col(source) if source else F.lit("")
    slim = df.select(F.coalesce(title, F.lit("untitled.txt")).alias("_title"), order.alias("_source"), F.md5(F.coalesce(col(text), F.lit(""))).alias("_tie"), col(text).alias("text"))
    placed = running_index(slim, ["_source", "_tie"], group=["_title"], out="_nth")
    number = F.format_string(" (%d)", F.col("_nth") + 1)
    stem, end = F.regexp_extract("_title", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("_title", r"^(.*?)(\.[^./]*)?$", 2)
    return placed.select(F.when(F.col("_nth") == 0, F.col("_title")).otherwise(F.concat(stem, number, end)).alias("document"), "text")


def write_texts(
    df: DataFrame, text: str, folder: str, source: str | None = None, name: str | None = None, per_document: bool = False
) -> None:
    """Document texts under their titles, as Parquet rows (document, text) in as many files as there are tasks.

    ``per_document`` writes a folder for each document instead, which suits small sets only.
    """
    titled = titled_texts(df, text, source, name)
    if per_document:
        titled.withColumnRenamed("text", "value").write.mode("overwrite").partitionBy("document").text(folder)
    else:
        titled.write.mode("overwrite").parquet(folder)


def numbered_parts(
    df: DataFrame, group: str, order: list[str], body: str, name: str | None = None, output_name: str | None = None
) -> DataFrame:
    """Parts of each group in order, with their number; a part named like the merged output
    (in any letter case) is left out. Order columns should be unique within a group."""
    kept = df.where(is_part(name, output_name))
    columns = list(dict.fromkeys([group, *order, *([name] if name else []), body]))
    slim = kept.select(*[col(c) for c in columns]).withColumn(
        "_bytes", F.coalesce(F.octet_length(col(body)), F.lit(0)).cast("bigint") + len(SEPARATOR)
    )
    placed = running_index(slim, order, weight="_bytes", group=[group], out="_offset")
    return placed


def merge_parts(
    df: DataFrame,
    group: str,
    order: list[str],
    body: str,
    name: str | None = None,
    output_name: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Ordered concatenation of the parts of each group.

    A group is cut into chunks of about ``chunk_bytes`` so that one group, however large, is never
    gathered in one place; the chunks of a group follow each other by ``chunk``. A group whose parts
    are all left out has one empty chunk of 0 parts.
    """
    placed = numbered_parts(df, group, order, body, name, output_name)
    chunk = F.expr(f"_offset div {chunk_bytes}")
    part = F.struct(F.col("_offset").alias("at"), F.coalesce(col(body), F.lit("")).alias("body"))
    merged = (
        placed.groupBy(col(group), chunk.alias("chunk"))
        # Bounded: the parts of one chunk hold chunk_bytes together, the last one aside.
        .agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list(part)).alias("_parts"))
        .select(
            col(group), "chunk", "parts",
            F.array_join(F.transform("_parts", lambda p: p["body"]), SEPARATOR).alias("merged"),
        )
    )
    if name is None or output_name is None:
        return merged
    without = df.groupBy(col(group)).agg(F.max(is_part(name, output_name).cast("int")).alias("_any")).where("_any = 0")
    return merged.unionByName(
        without.select(col(group), F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("parts"), F.lit("").alias("merged"))
    )


def is_part(name: str | None, output_name: str | None) -> Column:
    """Whether a row is a part to merge, not an earlier output (in any letter case)."""
    if name is None or output_name is None:
        return F.lit(True)
    return F.coalesce(F.lower(col(name)) != output_name.lower(), F.lit(True))


def part_sizes(df: DataFrame, group: str, part: list[str], body: str) -> DataFrame:
    size = F.coalesce(F.octet_length(col(body)), F.lit(0)).cast("bigint")
    return df.select(
        col(group), *[col(p) for p in part], size.alias("bytes"), F.expr(f"{_octets(body)} div 1024").alias("kb")
    )


def _octets(body: str) -> str:
    return f"coalesce(octet_length(`{body.replace('`', '``')}`), 0)"


def merge_size_report(df: DataFrame, group: str, body: str, name: str | None = None, output_name: str | None = None) -> DataFrame:
    """Per group and in total (``is_total``): parts, bytes of the parts and of the merged text, KB.

    Counts what ``merge_parts`` merges with the same ``name`` and ``output_name``; groups without
    parts are listed with 0. KB are whole and of the summed bytes, not a sum of rounded KB.
    """
    part = is_part(name, output_name)
    size = F.when(part, F.expr(f"cast({_octets(body)} as bigint)")).otherwise(0)
    per_group = df.groupBy(col(group)).agg(F.count_if(part).alias("parts"), F.sum(size).alias("bytes"))
    merged = F.col("bytes") + F.greatest(F.col("parts") - 1, F.lit(0)) * len(SEPARATOR)
    return (
        per_group.withColumn("merged_bytes", merged)
        .rollup(col(group))
        .agg(F.sum("parts").alias("parts"), F.sum("bytes").alias("bytes"), F.sum("merged_bytes").alias("merged_bytes"), (F.grouping(col(group)) == 1).alias("is_total"))
        .select(
            col(group), "is_total", "parts", "bytes", F.expr("bytes div 1024").alias("kb"),
            "merged_bytes", F.expr("merged_bytes div 1024").alias("merged_kb"),
        )
    )
