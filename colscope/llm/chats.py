"""Chat formatting of maximal conversations: logged snapshots that a longer log begins with are dropped. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Frames

# Turns rendered into one row; a longer conversation has several rows.
PART_TURNS = 64


def numbered_turns(conversations: DataFrame, frames: Frames) -> DataFrame:
    """(conv_id, role, text, number, n_turns, xa, xb): turns in order, with the rolling hash of all up to each.

    Turns are dealt out by range, so that a conversation of any length spreads over tasks. Within a
    range they are numbered and hashed in order; what comes from ranges before is known per range
    and conversation, and only conversations that cross a range's edge need it: at most one for
    each edge, few enough to be sent to all tasks.
    """
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit(""))).alias("tie")
    ).distinct()
    order = ["turn", "role", "tie"]
    ranged = frames.keep(turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    here = Window.partitionBy("range", "conv_id").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy("conv_id")

    sizes = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    crossing = sizes.withColumn("ranges", F.count(F.lit(1)).over(everywhere)).where("ranges > 1")
    crossing = crossing.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.sum("n").over(everywhere).alias("total"))
    numbered = ranged.join(F.broadcast(crossing), ["conv_id", "range"], "left").withColumn("number", F.row_number().over(here) + F.coalesce("earlier", F.lit(0)))
    numbered = numbered.withColumn("n_turns", F.coalesce("total", F.count(F.lit(1)).over(Window.partitionBy("range", "conv_id"))))
    hashed = frames.keep(
        numbered.select("conv_id", "range", *order, "text", "number", "n_turns", F.xxhash64("number", "role", "text").alias("a"), F.xxhash64("text", "role", F.col("number") + 7).alias("b"))
    )
    carried = hashed.where("n_turns is not null").groupBy("conv_id", "range").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = carried.withColumn("ranges", F.count(F.lit(1)).over(everywhere)).where("ranges > 1")
    carried = carried.select("conv_id", "range", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"carried_{c}") for c in "ab"))
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.join(F.broadcast(carried), ["conv_id", "range"], "left")
    rolling = (F.coalesce(F.col(f"carried_{c}"), F.lit(0)).bitwiseXOR(F.bit_xor(c).over(so_far)).alias(f"x{c}") for c in "ab")
    return frames.keep(rolled.select("conv_id", "role", "text", "number", "n_turns", *rolling))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with; of equal ones the smallest conv_id."""
    whole = turns.where(F.col("number") == F.col("n_turns")).groupBy("n_turns", "xa", "xb").agg(F.min("conv_id").alias("conv_id"))
    begun = turns.where(F.col("number") < F.col("n_turns")).select(F.col("number").alias("n_turns"), "xa", "xb").distinct()
    return whole.join(begun, ["n_turns", "xa", "xb"], "left_anti").select("conv_id", "n_turns")


def render_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, text): maximal conversations as chat text, ``part_turns`` turns a row.

    The parts of a conversation, put together in order, are its chat text. ``n_turns`` counts the
    turns of the part. Turns are ordered by turn, role and the MD5 of the text.

    Null roles and texts are empty; null turns come first; exactly repeated turns count once; turns
    with equal numbers all stay. Rows without conv_id belong to no conversation and are left out.
    An empty table gives no rows; other columns are not looked at.
    """
    frames = Frames(conversations.sparkSession)
    turns = numbered_turns(conversations.select("conv_id", "turn", "role", "text"), frames)
    kept = maximal(turns).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / part_turns))).alias("part"))
    piece = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    pieces = turns.select("conv_id", F.floor((F.col("number") - 1) / part_turns).alias("part"), "number", piece.alias("piece"))
    done = (
        pieces.join(kept, ["conv_id", "part"], "left_semi")
        .groupBy("conv_id", "part")
        .agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("number", "piece"))).alias("pieces"))
        .select("conv_id", "part", "n_turns", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))
    )
    frames.release(keep_last=1)
    return done
