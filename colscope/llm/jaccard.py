"""N-gram Jaccard join: an index of blocks that are skipped by position, and answers taken over between similar sets.

The links of a set that is highly similar to another need not be searched anew: both are in one
component by then, and index blocks that hold a single component are skipped as a whole. What is
left, sets of different components that share a rare shingle, is compared exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Frames, components, in_batches, utf8

# Shingles that more than about 3 * SAMPLE_PART documents hold go to the end of the global order;
# HOT_SHINGLES of them at most, found in one of SAMPLE_PART documents. Any order gives right results.
SAMPLE_PART = 16
HOT_SAMPLED = 3
HOT_SHINGLES = 65_536
# Two minima make a band, and BANDS bands propose a highly similar set.
BANDS = 4
# Entries of an index block: components that share one, and entries of one component.
BLOCK_COMPONENTS = 128
BLOCK_ENTRIES = 1024
# Words whose hashes a worker keeps, and bits of the bounded filter of ids.
KEPT_WORDS = 200_000
FILTER_BITS = 1 << 25

MASK = np.uint64((1 << 62) - 1)
HOT_FROM = 1 << 62


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link when den * intersection >= num * union."""

    words: int = 4
    num: int = 85
    den: int = 100

    def prefix(self, n: int) -> int:
        """How many of a set's first shingles any linked set must touch."""
        return n - -(-self.num * n // self.den) + 1 if n else 0

    def least_common(self, a: Column, b: Column) -> Column:
        return F.ceil(F.lit(self.num) * (a + b) / F.lit(self.num + self.den))

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.lit(self.den) * F.least(a, b) >= F.lit(self.num) * F.greatest(a, b)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and self.den * both >= self.num * (len(a) + len(b) - both)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted arrays of the different shingle hashes of texts."""

    def __init__(self, words: int):
        self.words, self.hashes = words, WordHashes()
        self.factors = mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.lower().split() for t in texts]
        ends = np.cumsum([len(w) for w in split])
        if len(self.hashes) > KEPT_WORDS:
            self.hashes.clear()
        hashes = np.fromiter((h for w in split for h in map(self.hashes.__getitem__, w)), dtype=np.uint64, count=int(ends[-1]) if len(split) else 0)
        k, out = self.words, []
        with np.errstate(over="ignore"):
            if len(hashes) >= k:
                rolled = sum(hashes[i : len(hashes) - k + 1 + i] * self.factors[i] for i in range(k))
                rolled = mixed(rolled) & MASK
            for n, end in zip(map(len, split), ends.tolist()):
                if n >= k:
                    out.append(np.unique(rolled[end - n : end - k + 1]))
                elif n:
                    whole = (hashes[end - n : end] * self.factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
                    out.append(mixed(np.array([whole], dtype=np.uint64)) & MASK)
                else:
                    out.append(np.zeros(0, dtype=np.uint64))
        return out


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def hot_shingles(documents: DataFrame, rule: Rule) -> list[int]:
    """The shingles that most documents of a sample hold, rarest first; a bounded list."""

    def step():
        shingler = Shingler(rule.words)

        def work(part):
            found = shingler.sets(part["text"])
            tokens, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
            return {"token": tokens.astype(np.int64), "n": counts}

        return work

    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PART)) == 0).select(utf8())
    found = (
        in_batches(sample, "token long, n long", step, "text")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= HOT_SAMPLED)
        .orderBy(F.desc("n"), "token")
        .limit(HOT_SHINGLES)
        .collect()
    )
    return [r["token"] for r in reversed(found)]


def signatures(documents: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, digest, bands, prefix) of every row: the set's size, its identity, bands of minima
    and its first shingles in the global order, as numbers that sort in that order."""
    hot = np.array(hot_shingles(documents, rule), dtype=np.uint64)
    by_value = np.argsort(hot)
    held = documents.sparkSession.sparkContext.broadcast((hot[by_value], by_value))
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def step():
        shingler = Shingler(rule.words)
        hot_values, hot_ranks = held.value
        turns = mixed(np.arange(100, 100 + 2 * BANDS, dtype=np.uint64)) | np.uint64(1)

        def work(part):
            out = {"doc_id": part["doc_id"], "n": [], "digest": [], "bands": [], "prefix": []}
            for x in shingler.sets(part["text"]):
                n = len(x)
                out["n"].append(n)
                if not n:
                    out["digest"].append(None)
                    out["bands"].append([])
                    out["prefix"].append([])
                    continue
                out["digest"].append(xxhash.xxh3_128_digest(x.tobytes()))
                with np.errstate(over="ignore"):
                    minima = [(x * t).min() for t in turns]
                    out["bands"].append(mixed(np.array([minima[2 * i] * turns[0] + minima[2 * i + 1] + np.uint64(i) for i in range(BANDS)], dtype=np.uint64)).astype(np.int64))
                if len(hot_values):
                    at = np.minimum(np.searchsorted(hot_values, x), len(hot_values) - 1)
                    common = hot_values[at] == x
                    if common.any():
                        x = np.sort(np.where(common, hot_ranks[at].astype(np.uint64) + np.uint64(HOT_FROM), x))
                out["prefix"].append(x[: rule.prefix(n)].astype(np.int64))
            return out

        return work

    schema = f"doc_id {id_type}, n int, digest binary, bands array<long>, prefix array<long>"
    return in_batches(documents.select("doc_id", utf8()), schema, step, "text")


def only_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of few documents: a filter of fixed size first, so that other texts aren't shuffled."""
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    # at most FILTER_BITS / 8 bytes, in rows of 4 KiB
    maps = (
        ids.select(code("doc_id").alias("code"))
        .groupBy(F.expr("code div 32768").alias("block"))
        .agg(F.expr("bitmap_construct_agg(code % 32768)").alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in maps:
        bits[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    held = documents.sparkSession.sparkContext.broadcast(bits)
    coded = documents.select("doc_id", utf8(), code("doc_id").alias("code"))

    def run(batches):
        known = held.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            if hit.any():
                yield batch.take(np.flatnonzero(hit)).select([0, 1])

    picked = coded.mapInArrow(run, coded.drop("code").schema)
    return picked.join(ids.select("doc_id"), "doc_id", "left_semi")


def verified(documents: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose whole sets link. A pair's own rows only are compared, never a group."""
    frames = Frames(documents.sparkSession)
    pairs = frames.keep(pairs.select("a", "b").distinct())
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = frames.keep(only_ids(documents, ids))
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b").join(
        texts.select(F.col("doc_id").alias("a"), "text"), "a"
    )
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def step():
        shingler, kept = Shingler(rule.words), {}

        def one(text):
            if text not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[text] = shingler.sets([text])[0]
            return kept[text]

        def work(part):
            linked = [rule.linked(one(x), one(y)) for x, y in zip(part["text"], part["other"])]
            return {k: [v for v, yes in zip(part[k], linked) if yes] for k in ("a", "b")}

        return work

    return in_batches(both.select("a", "b", "text", "other"), f"a {id_type}, b {id_type}", step, "text")


def similar_pairs(nodes: DataFrame, rule: Rule, frames: Frames) -> DataFrame:
    """Each set with the smallest set of its bands: few pairs, most of them highly similar."""
    keyed = nodes.select("doc_id", "n", F.explode("bands").alias("band"))
    # written before the join, so that a hot band is split like any skewed key
    first = frames.keep(keyed.groupBy("band").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last"))
    return (
        keyed.join(first, "band")
        .where((F.col("doc_id") != F.col("first.doc_id")) & rule.sizes_fit(F.col("n"), F.col("first.n")))
        .select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b"))
        .distinct()
    )


def index_blocks(entries: DataFrame, counts: DataFrame, rule: Rule) -> DataFrame:
    """Blocks of the lists of shingles that different components hold.

    A block has entries of like size and position, so that whole blocks can be skipped; a long
    list is cut by component and, within one, by id.
    """
    listed = entries.join(counts.select("token", "n_entries"), "token")
    # of the shingles before this one only those in the index can be shared with another component
    before = Window.partitionBy("doc_id", "n", "last").orderBy("pos")
    listed = listed.withColumn("seen", F.row_number().over(before) - 1)
    size_class = F.floor(F.log("n") / math.log(rule.den / rule.num)).alias("size_class")
    width = F.greatest(F.lit(1), F.ceil(F.col("n") * (1 - rule.num / rule.den) / 2))
    return (
        listed.select(
            "token",
            size_class,
            F.floor(F.col("pos") / width).alias("place"),
            F.pmod(F.xxhash64("component"), F.ceil(F.col("n_entries") / BLOCK_COMPONENTS)).alias("part"),
            F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_entries") / BLOCK_ENTRIES)).alias("salt"),
            F.struct("doc_id", "n", "pos", "seen", "last", "component").alias("entry"),
        )
        .groupBy("token", "size_class", "place", "part", "salt")
        .agg(
            F.collect_list("entry").alias("entries"),
            *(f(F.col(f"entry.{c}")).alias(f"{name}_{c}") for c in ("n", "pos", "seen", "component") for name, f in (("min", F.min), ("max", F.max))),
        )
    )


def cross_pairs(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of sets of different components that could link, from pairs of blocks that can't be skipped."""
    number = ["size_class", "place", "part", "salt"]
    x, y = blocks.alias("x"), blocks.alias("y")
    c = F.col
    order_x, order_y = F.struct(*(c(f"x.{k}") for k in number)), F.struct(*(c(f"y.{k}") for k in number))
    sizes = (F.lit(rule.den) * c("x.max_n") >= F.lit(rule.num) * c("y.min_n")) & (F.lit(rule.den) * c("y.max_n") >= F.lit(rule.num) * c("x.min_n"))
    places = F.least("x.max_seen", "y.max_seen") + F.least(c("x.max_n") - c("x.min_pos"), c("y.max_n") - c("y.min_pos")) >= rule.least_common(c("x.min_n"), c("y.min_n"))
    others = ~((c("x.min_component") == c("x.max_component")) & (c("y.min_component") == c("y.max_component")) & (c("x.min_component") == c("y.min_component")))
    met = x.join(y, (c("x.token") == c("y.token")) & (order_x <= order_y) & sizes & places & others)
    same = order_x == order_y

    def fits(p: Column, q: Column) -> Column:
        room = F.least(p["seen"], q["seen"]) + F.least(p["n"] - p["pos"], q["n"] - q["pos"])
        return (p["component"] != q["component"]) & rule.sizes_fit(p["n"], q["n"]) & (room >= rule.least_common(p["n"], q["n"])) & (~same | (p["doc_id"] < q["doc_id"]))

    found = F.flatten(F.transform("x.entries", lambda p: F.transform(F.filter("y.entries", lambda q: fits(p, q)), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    pairs = met.select(F.explode(found).alias("pair"))
    p, q = c("pair.p"), c("pair.q")
    swap = p["doc_id"] > q["doc_id"]
    counted = (
        pairs.select(F.when(swap, q).otherwise(p).alias("p"), F.when(swap, p).otherwise(q).alias("q"))
        .select(*(c(f"{s}.{k}").alias(f"{s}_{k}") for s in "pq" for k in ("doc_id", "n", "last")))
        .groupBy("p_doc_id", "p_n", "p_last", "q_doc_id", "q_n", "q_last")
        .agg(F.count(F.lit(1)).alias("common"))
    )
    # up to the smaller of the two last prefix shingles, what the sets share is known
    prefix = lambda n: n - F.ceil(F.lit(rule.num) * n / F.lit(rule.den)) + 1
    rest = F.when(c("p_last") <= c("q_last"), c("p_n") - prefix(c("p_n"))).otherwise(c("q_n") - prefix(c("q_n")))
    return counted.where(c("common") + rest >= rule.least_common(c("p_n"), c("q_n"))).select(c("p_doc_id").alias("a"), c("q_doc_id").alias("b"))


def jaccard_components(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are runs without blanks, A-Z lowered; a text of fewer words than a shingle has its whole
    sequence as the one shingle. Null or empty texts have no shingles and link with nothing. Rows
    without doc_id link with nothing and have a null component. Rows of one doc_id are one node: it
    has the links of each of its texts. No rows give no rows; other columns are not looked at.
    """
    spark = documents.sparkSession
    frames = Frames(spark)
    documents = documents.select("doc_id", "text")
    signed = frames.keep(signatures(documents, rule))
    whole = signed.where("n > 0 and doc_id is not null")

    # rows of one doc_id with one set: a single one goes on, or their joins would pair each with each
    repeated = frames.keep(whole.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"))
    if repeated.limit(1).count():
        columns = ["doc_id", "n", "digest", "bands", "prefix"]
        single = whole.join(repeated, ["doc_id", "digest"], "left_anti").select(columns)
        merged = whole.join(repeated, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(*(F.first(c).alias(c) for c in ("n", "bands", "prefix")))
        whole = frames.keep(single.union(merged.select(columns)))

    # equal sets: one of them stands for all
    first = frames.keep(whole.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("digest", "first"))
    copies = frames.keep(whole.select("doc_id", "digest").join(first, "digest").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"), "digest"))
    left_out = copies.select(F.col("b").alias("doc_id"), "digest").distinct()
    nodes = frames.keep(whole.select("doc_id", "digest", "n", "bands").join(left_out, ["doc_id", "digest"], "left_anti"))

    # highly similar sets: the answers of one hold for the other
    similar = frames.keep(verified(documents, similar_pairs(nodes, rule, frames), rule))
    taken = components(similar)
    placed = nodes.join(taken.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "digest", F.coalesce("component", "doc_id").alias("component"))
    entries = whole.select("doc_id", "digest", "n", "prefix").join(placed, ["doc_id", "digest"])
    entries = entries.select("doc_id", "n", "component", F.element_at("prefix", -1).alias("last"), F.posexplode("prefix").alias("pos", "token"))

    # the rest: shingles that several components hold
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n_entries"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    counts = frames.keep(counts.select("token", "n_entries"))
    further = frames.keep(verified(documents, cross_pairs(frames.keep(index_blocks(entries, counts, rule)), rule), rule))

    # of the similar sets each is tied to its component once
    links = copies.select("a", "b").union(taken.select(F.col("component").alias("a"), F.col("node").alias("b"))).union(further.select("a", "b"))
    labels = components(links).withColumnRenamed("node", "doc_id")
    done = frames.keep(
        signed.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
        .join(labels, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
    frames.release(keep_last=1)
    return done
