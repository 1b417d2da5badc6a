"""Embedding near-dedup by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Frames, components, in_batches

# Trees, their base directions, the share of a node on either side of a split that goes both ways,
# the size up to which a node is a leaf, and the least cosine of a link.
TREES = 6
DIRECTIONS = 12
SPILL = 0.1
LEAF = 256
LEAST_COSINE = 0.93
# A node that this many splits have not brought down to a leaf is compared in blocks instead.
MOST_SPLITS = 48
# Points of a label that are looked through together for dense groups, sign bits that deal a label
# into such cells, and bytes of group centres that tasks hold at a time.
CELL = 1024
MOST_BITS = 30
CENTRE_BYTES = 8 << 20
# Points of a node that are looked at to tell whether it is dense, and the least share of them that one
# of them has to link to.
NODE_SAMPLE = 32
DENSE_SHARE = 0.5
SEED = 11


def directions(tree: int, size: int) -> np.ndarray:
    """The tree's base directions, made anew from a seed wherever they are needed."""
    return np.random.default_rng([SEED, tree, size]).standard_normal((DIRECTIONS, size))


def split_value(tree: int, depth: int) -> Column:
    """A row's place along the direction of one depth, from its base projections ``at``.

    Below the base directions further ones are random mixtures of them.
    """
    if depth < DIRECTIONS:
        return F.element_at("at", depth + 1)
    mix = np.random.default_rng([SEED, tree, 0, depth]).standard_normal(DIRECTIONS)
    return sum((F.element_at("at", i + 1) * float(c) for i, c in enumerate(mix)), F.lit(0.0))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, digest, vector, at) of the vectors that can link.

    ``label`` as text; ``digest`` tells equal directions; ``at`` holds a base projection per tree and direction.
    """
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def step():
        bases: dict[int, np.ndarray] = {}

        def work(part):
            out = {k: [] for k in ("vec_id", "label", "size", "digest", "vector", "at")}
            for vec_id, label, raw in zip(part["vec_id"], part["label"], part["embedding"]):
                if not raw or any(v is None for v in raw):
                    continue
                x = np.array(raw, dtype=np.float64) + 0.0
                norm = np.linalg.norm(x)
                if not np.isfinite(x).all() or not np.isfinite(norm) or norm == 0:
                    continue
                if len(x) not in bases:
                    bases[len(x)] = np.concatenate([directions(t, len(x)) for t in range(TREES)])
                unit = x / norm + 0.0
                for k, v in zip(out, (vec_id, label, len(x), xxhash.xxh3_128_digest(unit.tobytes()), x, bases[len(x)] @ unit)):
                    out[k].append(v)
            return out

        return work

    rows = vectors.where("vec_id is not null and label is not null").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return in_batches(rows, f"vec_id {id_type}, label string, size int, digest binary, vector array<double>, at array<double>", step)


def unit_rows(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(points: DataFrame, leaf: int, least: float, frames: Frames) -> DataFrame:
    """(label, size, point, vector): points that more than half a leaf of points of their label link to.

    A label is dealt into cells by the signs of projections, so that a group of any share of it
    fills a good part of some cell; a cell that is still too large is sampled. Every centre stands
    for points that earlier ones of its cell leave.
    """
    key, cell = ["label", "size"], ["label", "size", "cell"]
    totals = frames.keep(points.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf))
    bits = F.ceil(F.log2(F.col("n") / CELL))
    number = sum((F.when((F.lit(i) < bits) & (F.element_at("at", i + 1) >= 0), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(MOST_BITS)), F.lit(0))
    placed = frames.keep(points.join(totals, key).select(*key, number.alias("cell"), "point", "vector"))
    sizes = frames.keep(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > leaf / 2))
    looked = placed.join(sizes, cell).where(F.pmod(F.xxhash64("point", F.lit(CELL)), F.col("held")) < CELL)

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        enough = max(leaf / 2 * len(part) / int(part["held"].iloc[0]), 3)
        x = unit_rows(part["vector"])
        near = x @ x.T >= least
        counts, free, out = near.sum(axis=1), np.ones(len(x), dtype=bool), []
        while counts[i := int(counts.argmax())] > enough:
            out.append(i)
            gone = near[i] & free
            free &= ~gone
            counts = counts - near[:, gone].sum(axis=1)
        return part.iloc[out][[*key, "point", "vector"]]

    return frames.keep(looked.groupBy(*cell).applyInPandas(pick, "label string, size int, point long, vector array<double>"))


def dense_groups(points: DataFrame, leaf: int, least: float, frames: Frames) -> DataFrame | None:
    """(point, code, members, core): for each centre all points within twice the link angle.

    A point within the link angle of a centre is a core: whatever it links to is in the centre's
    group, so that it needs no tree. The driver and the tasks hold ``CENTRE_BYTES`` of centres.
    """
    # what links to a core lies within twice the link angle of its centre
    far = 2 * least * least - 1 - 1e-9 if least > 0 else -2.0
    found: list[DataFrame] = []

    def search(group: dict) -> None:
        held = points.sparkSession.sparkContext.broadcast({k: (np.array([c for c, _ in v], dtype=np.int64), unit_rows(x for _, x in v)) for k, v in group.items()})

        def step():
            def work(part):
                out = {"point": [], "code": [], "core": []}
                ids, rows = np.array(part["point"], dtype=np.int64), {}
                for i, k in enumerate(zip(part["label"], part["size"])):
                    if k in held.value:
                        rows.setdefault(k, []).append(i)
                for k, mine in rows.items():
                    codes, middle = held.value[k]
                    many = max(1, (4 << 20) // len(codes))
                    for start in range(0, len(mine), many):
                        some = mine[start : start + many]
                        cosines = unit_rows(part["vector"][i] for i in some) @ middle.T
                        i, j = np.nonzero(cosines >= far)
                        for c, v in (("point", ids[some][i]), ("code", codes[j]), ("core", cosines[i, j] >= least)):
                            out[c].extend(v.tolist())
                return out

            return work

        found.append(frames.keep(in_batches(points.select("point", "label", "size", "vector"), "point long, code long, core boolean", step)))

    code = F.xxhash64("label", "size", F.lit("centre"), "point").alias("code")
    group, total = {}, 0
    for r in centres(points, leaf, least, frames).select("label", "size", code, "vector").toLocalIterator():
        if total >= CENTRE_BYTES:
            search(group)
            group, total = {}, 0
        group.setdefault((r["label"], r["size"]), []).append((r["code"], r["vector"]))
        total += 8 * r["size"]
    if group:
        search(group)
    if not found:
        return None
    places = found[0]
    for more in found[1:]:
        places = places.union(more)
    sizes = frames.keep(places.groupBy("code").agg(F.count(F.lit(1)).alias("members")))
    return frames.keep(places.join(sizes, "code").select("point", "code", "members", "core"))


def dense_nodes(state: DataFrame, large: DataFrame, vectors: DataFrame, least: float, depth: int, frames: Frames) -> DataFrame | None:
    """(code) of the nodes in ``large`` most of whose points link to one of them, judged by a sample of each.

    Base projections, which the nodes hold, leave few to be judged by whole vectors.
    """
    sample = state.join(large, ["label", "size", "tree", "node"]).where(F.pmod(F.xxhash64("vec_id", F.lit(depth)), F.col("members")) < NODE_SAMPLE)
    sample = frames.keep(sample.select("code", "vec_id", "at"))

    def judge(near, column: str):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            linked = near(np.stack(part[column].to_list()).astype(np.float64))
            return part[["code"]].iloc[: int(linked.sum(axis=1).max() >= DENSE_SHARE * len(part) > 1)]

        return run

    def maybe(x: np.ndarray) -> np.ndarray:
        # a projection's squared difference is that of the vectors on average; twice of it in twelve is rare
        apart = ((x[:, None, :] - x[None, :, :]) ** 2).mean(axis=2)
        return apart <= 2 * 2 * (1 - least)

    def surely(x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return x @ x.T >= least

    likely = frames.keep(sample.groupBy("code").applyInPandas(judge(maybe, "at"), "code long"))
    if likely.limit(1).count() == 0:
        return None
    held = sample.join(likely, "code", "left_semi").select("code", "vec_id").join(vectors, "vec_id")
    return frames.keep(held.groupBy("code").applyInPandas(judge(surely, "vector"), "code long"))


def leaves(points: DataFrame, leaf: int, spill: float, frames: Frames, vectors: DataFrame | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, label, size, tree, node, members): every leaf that each point falls into.

    All nodes of a depth split together: their quantiles are merged from the tasks' sketches, and
    points near the median go to both sides. Nodes that are leaves step aside; a node without a gap
    between its cuts cannot be split and is a leaf of any size, and so is, where ``vectors``
    (vec_id, vector) are given, a node most of whose points link to one of them.
    """
    slices = F.array(*(F.struct(F.lit(t).alias("tree"), F.slice("at", t * DIRECTIONS + 1, DIRECTIONS).alias("at")) for t in range(TREES)))
    key = ["label", "size", "tree", "node"]
    state = points.select("vec_id", "label", "size", F.explode(slices).alias("x")).select("vec_id", "label", "size", "x.tree", F.lit(1).cast("decimal(38,0)").alias("node"), "x.at")
    done: list[DataFrame] = []
    for depth in range(MOST_SPLITS + 1):
        state = frames.keep(state)
        value = F.coalesce(*(F.when(F.col("tree") == t, split_value(t, depth)) for t in range(TREES)))
        cuts = state.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.percentile_approx(value, [0.5 - spill, 0.5 + spill], 2000).alias("cut"))
        # without a gap between the cuts the upper side would get every point
        small = (F.col("members") <= leaf) | (F.col("cut")[0] >= F.col("cut")[1]) | F.lit(depth == MOST_SPLITS)
        cuts = frames.keep(cuts.select("*", F.xxhash64(*key).alias("code"), small.alias("small")))
        large = cuts.where(~F.col("small"))
        dense = None if vectors is None or large.limit(1).count() == 0 else dense_nodes(state, large.select(*key, "members", "code"), vectors, least, depth, frames)
        if dense is not None:
            marked = cuts.join(dense.withColumn("dense", F.lit(True)), "code", "left")
            cuts = frames.keep(marked.withColumn("small", F.col("small") | F.coalesce("dense", F.lit(False))).drop("dense"))
        placed = state.join(cuts.drop("code"), key)
        done.append(frames.keep(placed.where("small").select("vec_id", *key, "members")))
        large = placed.where(~F.col("small")).withColumn("value", value)
        sides = F.concat(F.when(F.col("value") <= F.col("cut")[1], F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(F.col("value") >= F.col("cut")[0], F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
        state = large.select("vec_id", "label", "size", "tree", F.col("node"), "at", F.explode(sides).alias("side")).withColumn("node", (F.col("node") * 2 + F.col("side")).cast("decimal(38,0)")).drop("side")
        if cuts.where(~F.col("small")).limit(1).count() == 0:
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def first_met(earlier: list[frozenset], others: list[frozenset]) -> np.ndarray:
    """Whether two points share one of the leaves that come before this one."""
    codes = {c: i for i, c in enumerate({c for s in (*earlier, *others) for c in s})}
    if not codes:
        return np.zeros((len(earlier), len(others)), dtype=bool)

    def table(sets):
        out = np.zeros((len(sets), len(codes)), dtype=np.float32)
        for i, s in enumerate(sets):
            out[i, [codes[c] for c in s]] = 1
        return out

    return table(earlier) @ table(others).T > 0


def compare(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links within a leaf, or between two blocks of one: per point their number and one smaller neighbour's id.

    A link is counted in the first leaf that its ends share; the ids join all points that are
    connected here. Only as many rows leave as came in.
    """
    code = int(rows["code"].iloc[0])
    low, high = rows["low"].iloc[0], rows["high"].iloc[0]
    left, right = (rows, rows) if low == high else (rows[rows["block"] == low], rows[rows["block"] == high])
    if not len(left) or not len(right):
        return pd.DataFrame({"point": rows["point"].iloc[:0], "vec_id": rows["vec_id"].iloc[:0], "links": [], "near": rows["vec_id"].iloc[:0]})
    x, y = (np.stack(side["vector"].to_list()).astype(np.float64) for side in (left, right))
    linked = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= least
    if low == high:
        np.fill_diagonal(linked, False)
        linked &= linked.T
    before = [[frozenset(c for c in codes if c < code) for codes in side["codes"]] for side in (left, right)]
    new = linked & ~first_met(*before)
    ids = np.concatenate([left["vec_id"], right["vec_id"]]) if low != high else left["vec_id"].to_numpy()
    n, shift = len(ids), len(left) if low != high else 0
    counts = np.zeros(n)
    counts[: len(left)] += new @ right["copies"].to_numpy(dtype=float)
    if shift:
        counts[shift:] += left["copies"].to_numpy(dtype=float) @ new
    # smallest id around, then around those, until nothing changes
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    while True:
        a, b = rank[: len(left)], rank[shift:]
        down = np.minimum(a, np.where(linked, b[None, :], n).min(axis=1))
        up = np.minimum(b, np.where(linked, a[:, None], n).min(axis=0))
        after = np.concatenate([down, up]) if shift else np.minimum(down, up)
        after = np.minimum(after, after[order[after]])
        if (after == rank).all():
            break
        rank = after
    points = np.concatenate([left["point"], right["point"]]) if shift else left["point"].to_numpy()
    return pd.DataFrame({"point": points, "vec_id": ids, "links": counts.astype(np.int64), "near": ids[order[rank]]})


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Vectors link when their labels are equal and their cosine, in double precision, is at least
    ``least``. Points in the midst of a dense group are compared with all that can link to them and
    miss nothing. Links of the others are looked for within the leaves of all trees, of which nodes that
    are mostly one group are never split; a pair that no leaf holds together is missed, a wrong one is
    never reported. Equal directions are compared
    once. Dense groups and leaves that cannot be split are compared block by block in tasks of
    bounded size.

    Null labels or embeddings, null or non-finite components, zero or empty vectors: no links, a
    component of its own. A null vec_id has no links and a null component. Vectors of different
    lengths don't link. Rows of one vec_id are one vector with the links of each. Empty tables give
    no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    frames = Frames(spark)
    vectors = vectors.select("vec_id", "embedding", "label")
    same = ["label", "size", "digest"]
    ready = frames.keep(prepared(vectors))
    known = ready.select("vec_id", *same).distinct()
    # written before the join, so that a hot vector is split like any skewed key
    groups = frames.keep(known.groupBy(*same).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    members = frames.keep(known.join(groups, same))
    points = frames.keep(
        ready.join(groups.select(*same, F.col("first").alias("vec_id"), "copies"), [*same, "vec_id"]).dropDuplicates([*same, "vec_id"])
    )
    # a point is a vector; ids can repeat with other vectors
    point = F.xxhash64("label", "size", "digest").alias("point")
    points = points.select("*", point)

    dense = dense_groups(points, leaf, least, frames)
    sparse = points.select(F.col("point").alias("vec_id"), "label", "size", "at")
    if dense is not None:
        sparse = sparse.join(dense.where("core").select(F.col("point").alias("vec_id")).distinct(), "vec_id", "left_anti")
    fallen = leaves(sparse, leaf, spill, frames, points.select(F.col("point").alias("vec_id"), "vector"), least)
    code = F.xxhash64("label", "size", "tree", "node")
    fallen = fallen.select(F.col("vec_id").alias("point"), code.alias("code"), "members")
    if dense is not None:
        fallen = fallen.union(dense.select("point", "code", "members"))
    fallen = frames.keep(fallen)
    blocks = F.ceil(F.col("members") / (1.25 * leaf)).cast("int")
    block = F.pmod(F.xxhash64("point", "code"), blocks).cast("int")
    sets = fallen.groupBy("point").agg(F.collect_set("code").alias("codes"), F.collect_list(F.struct("code", blocks.alias("blocks"), block.alias("block"))).alias("places"))
    rows = points.join(sets, "point").select("point", "vec_id", "vector", "copies", "codes", "label", "size", F.explode("places").alias("place"))
    rows = rows.select("point", "vec_id", "vector", "copies", "codes", "label", "size", "place.code", "place.block", F.explode(F.sequence(F.lit(0), F.col("place.blocks") - 1)).alias("other"))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def leaf_links(part: pd.DataFrame) -> pd.DataFrame:
        return compare(part, least)

    found = frames.keep(rows.groupBy("label", "size", "code", "low", "high").applyInPandas(leaf_links, f"point long, vec_id {id_type}, links long, near {id_type}"))
    direct = found.groupBy("point").agg(F.sum("links").alias("links"))

    links = found.where("vec_id <> near").select(F.col("near").alias("a"), F.col("vec_id").alias("b"))
    links = links.union(members.where("first <> vec_id").select(F.col("first").alias("a"), F.col("vec_id").alias("b")))
    labels = components(links).withColumnRenamed("node", "vec_id")
    counted = (
        members.select("vec_id", "copies", point)
        .join(direct, "point", "left")
        .groupBy("vec_id")
        .agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    )
    done = frames.keep(
        vectors.select("vec_id").distinct()
        .join(counted, "vec_id", "left")
        .join(labels, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
    frames.release(keep_last=1)
    return done


def brute_force(rows: list[tuple], least: float = LEAST_COSINE) -> Iterator[tuple]:
    """(a, b) of all links of (vec_id, vector, label) rows, for tests and recall."""
    usable = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in rows if lab is not None and v and None not in v]
    usable = [(i, v, lab) for i, v, lab in usable if np.isfinite(v).all() and math.sqrt(v @ v) > 0]
    for lab in {u[2] for u in usable}:
        mine = [u for u in usable if u[2] == lab]
        x = np.stack([u[1] for u in mine])
        norms = np.linalg.norm(x, axis=1)
        for i, j in zip(*np.nonzero(np.triu((x @ x.T) / np.outer(norms, norms) >= least, 1))):
            yield mine[i][0], mine[j][0]
