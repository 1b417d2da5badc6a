"""Line dedup over range-partitioned line hashes, with keep bitmaps instead of text. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_rows
from .common import LOWER, UPPER

# What is stripped at both ends of a line, its shortest key, and the fewest documents.
STRIPPED = " \t\n\x0b\f\r"
LEAST_CHARS = 40
LEAST_DOCUMENTS = 5

# Hot keys are looked for in one of SAMPLE_PART documents: at most HOT_KEYS keys that at least
# HOT_SAMPLED documents of the sample hold. The sample decides how a key travels, never its fate.
SAMPLE_PART = 32
HOT_SAMPLED = 32
HOT_KEYS = 1024


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, doc_id, twin, pos) of every line whose key is long enough.

    ``key`` is the MD5 of the stripped line with A-Z lowered; ``twin`` tells rows of one doc_id
    with different texts apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = documents.select("doc_id", F.xxhash64(text).alias("twin"), F.posexplode(F.split(F.translate(text, UPPER, LOWER), "\n", -1)).alias("pos", "line"))
    return (
        lines.select("doc_id", "twin", "pos", F.btrim("line", F.lit(STRIPPED)).alias("line"))
        .where(F.char_length("line") >= least_chars)
        .select(F.unhex(F.md5("line")).alias("key"), "doc_id", "twin", "pos")
    )


def hot_keys(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame | None:
    """(key) of at most ``HOT_KEYS`` lines that very many documents hold, as a local table."""
    spark = documents.sparkSession
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PART)) == 0)
    found = (
        line_keys(sample, least_chars)
        .groupBy("key")
        .agg(F.approx_count_distinct("doc_id").alias("n"))
        .where(F.col("n") >= max(HOT_SAMPLED, 2 * least_documents))
        .orderBy(F.desc("n"), "key")
        .limit(HOT_KEYS)
        .collect()
    )
    return local_rows(spark, [(bytes(r["key"]),) for r in found], "key binary") if found else None


def dropped_lines(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, twin, pos) of the lines that go.

    A key's rows meet in one range of the hash space, sorted by document and position; the first
    document of each run keeps its lines. The ranges are cut from the hash's own leading bits, which
    are spread evenly, so no sampling pass over the lines is needed. Hot keys never meet: their few
    totals are summed in the tasks first and sent to where the lines are, which settles each row;
    settled rows spread over all ranges.
    """
    lines = line_keys(documents, least_chars)
    hot = hot_keys(documents, least_chars, least_documents)
    range_of = F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int")
    if hot is None:
        ranged = lines.withColumn("range", range_of).withColumn("decided", F.lit(False))
    else:
        totals = (
            lines.join(F.broadcast(hot), "key", "left_semi")
            .groupBy("key", "doc_id")
            .agg(F.lit(1).alias("one"))
            .groupBy("key")
            .agg((F.count("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("holders"), F.max("doc_id").alias("keeper"))
        )
        # at most HOT_KEYS rows of a hash, a count and an id
        totals = local_rows(documents.sparkSession, [tuple(r) for r in totals.collect()], totals.schema)
        known = lines.join(F.broadcast(totals), "key", "left").where(
            F.col("holders").isNull() | ((F.col("holders") >= least_documents) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
        )
        ranged = known.select(
            "key", "doc_id", "twin", "pos",
            F.when(F.col("holders").isNull(), range_of).otherwise(F.pmod(F.hash("doc_id", "pos"), F.lit(1 << 16))).alias("range"),
            F.col("holders").isNotNull().alias("decided"),
        )
    ranged = ranged.repartition("range").sortWithinPartitions("range", "key", F.desc_nulls_last("doc_id"), "pos")
    run = Window.partitionBy("range", "key")
    stream = ranged.withColumn("nth", F.dense_rank().over(run.orderBy(F.desc_nulls_last("doc_id"))))
    stream = stream.withColumn("n", F.max("nth").over(run))
    return stream.where(F.col("decided") | ((F.col("n") >= least_documents) & (F.col("nth") > 1))).select("doc_id", "twin", "pos")


def keep_bitmaps(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, twin, keep): 64-line words of keep bits, for documents that lose lines.

    ``keep`` maps a word's number to its bits; words whose lines all stay are left out.
    """
    gone = dropped_lines(documents.select("doc_id", "text"), least_chars, least_documents)
    words = gone.select("doc_id", "twin", F.expr("pos div 64").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    return (
        words.repartition("doc_id", "twin")
        .groupBy("doc_id", "twin", "word")
        .agg(F.bitwise_not(F.bit_or("bit")).alias("bits"))
        .groupBy("doc_id", "twin")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))
    )


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` and ``n_dropped`` in a struct column ``__lines``."""
    marked = documents.withColumn("__twin", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    bitmaps = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("twin").alias("__map_twin"), F.col("keep").alias("__keep"))
    joined = marked.join(bitmaps, marked["doc_id"].eqNullSafe(F.col("__doc")) & (F.col("__twin") == F.col("__map_twin")), "left")
    lines = split_lines(F.col("text"))
    bits = lambda i: F.try_element_at(F.col("__keep"), F.expr("0L") + F.floor(i / 64))
    kept = F.filter(lines, lambda line, i: F.coalesce(F.getbit(bits(i), (i % 64)), F.lit(1)) == 1)
    done = joined.withColumn(
        "__lines",
        F.when(F.col("__keep").isNull(), F.struct(F.coalesce("text", F.lit("")).alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))).otherwise(
            F.struct(F.array_join(kept, "\n").alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"))
        ),
    )
    return done.drop("__twin", "__doc", "__map_twin", "__keep")


def dedup_lines(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per document row: doc_id, kept_text, n_lines (before dropping), n_dropped.

    A line's key is the line stripped of blanks with A-Z lowered. Keys of at least ``least_chars``
    code points in at least ``least_documents`` different doc_ids stay only in the largest doc_id.

    Null or empty text: one empty line, kept. Null doc_id: one more document, below all others.
    Repeated rows of a doc_id count as one document and each is returned. No rows: no rows. Other
    columns are not looked at.
    """
    documents = documents.select("doc_id", "text")
    done = apply_bitmaps(documents, keep_bitmaps(documents, least_chars, least_documents))
    return done.select("doc_id", "__lines.kept_text", "__lines.n_lines", "__lines.n_dropped")
