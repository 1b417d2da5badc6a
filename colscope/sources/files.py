"""Files per folder, from a listing only; no file content is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """(inner path, extension) of every file below the root."""
    plain = re.sub(r"^[a-zA-Z0-9]+:(//[^/]*)?", "", root).rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    path = F.regexp_replace("path", "^[a-zA-Z0-9]+:(//[^/]*)?", "")
    inner = F.substring(path, F.lit(len(plain) + 2), F.length(path))
    return files.select(inner.alias("inner")).select(
        "inner", F.lower(F.regexp_extract("inner", "[^/]\\.([^./]*)$", 1)).alias("extension")
    )


def _per_folder(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """Hits per immediate sub-folder, or for the root itself when it has no sub-folder."""
    listed = _listing(spark, root)
    top = F.element_at(F.split("inner", "/"), 1)
    depth = F.size(F.split("inner", "/"))
    hit = (F.col("extension") == extension.lower().lstrip(".")).cast("int")
    # Files deeper than one level only show that the folder exists.
    counted = (
        listed.select(F.when(depth > 1, top).alias("folder"), F.when(depth <= 2, hit).otherwise(0).alias("hit"))
        .groupBy("folder")
        .agg(F.sum("hit").alias("files"))
    )
    if listed.where(depth > 1).limit(1).count():
        counted = counted.where(F.col("folder").isNotNull())
    return counted.select(F.coalesce("folder", F.lit(".")).alias("folder"), "files")


def file_inventory(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """Folders with at least one hit, by name."""
    return _per_folder(spark, root, extension).where(F.col("files") > 0).orderBy("folder")


def file_inventory_totals(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """One row: all hits and folders looked at. An empty folder has no file and is not seen."""
    return _per_folder(spark, root, extension).agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
        F.count_if(F.col("folder") != ".").alias("folders"),
    )
