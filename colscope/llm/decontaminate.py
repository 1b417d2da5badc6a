"""Benchmark decontamination: block-max WAND over a BM25 index of the test items, then overlap checks.

Every passage of every document is a query. The index, not the documents, is cut into shards of
bounded size; each pass over the documents takes the shards that fit together.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_rows
from .common import in_batches, utf8

# BM25's usual constants, and the share of an item's own score that a passage must reach.
K1, B = 1.2, 0.75
LEAST_SCORE = 0.5
# The check of a hit: word runs, and the share of those of the question and of the answer.
RUN = 5
LEAST_OVERLAP = 0.5
# Items of a posting block; the share of the least score that all weak terms together stay below;
# bytes of item text in one shard and in the shards of one pass; the shortest span that a shard's
# windows are made for; cells of the table of windows and blocks that a task fills at a time.
BLOCK = 2
WEAK_SHARE = 0.25
SHARD_BYTES = 1 << 20
PASS_BYTES = 16 << 20
LEAST_SPAN = 32
CELLS = 4 << 20

WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def parts_of(text: str, answer: str | None = None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer.

    Without a column for answers the last sentence is the answer, if it and the rest are long
    enough for a run of words; else all is question.
    """
    if answer is not None:
        return words_of(text), words_of(answer)
    cut = max((m.end() for m in re.finditer(r"[.!?\n]\s*(?=\S)", text)), default=0)
    question, last = words_of(text[:cut]), words_of(text[cut:])
    return (question, last) if min(len(question), len(last)) >= RUN else (question + last, [])


@dataclass
class Shard:
    """Items of like length, their impact-scaled postings in blocks, and their word runs."""

    item_ids: list
    span: int
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[list[tuple[int, float]]] = field(default_factory=list)
    runs: list[tuple[frozenset, frozenset]] = field(default_factory=list)

    def seal(self) -> None:
        """Block maxima per term, bounds per term, and the terms too weak to make a hit together."""
        self.n_blocks = -(-len(self.item_ids) // BLOCK)
        self.items = [[i for i, _ in p] for p in self.postings]
        self.impacts = [[v for _, v in p] for p in self.postings]
        blocks = []
        for p in self.postings:
            best: dict[int, float] = {}
            for i, v in p:
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), v)
            blocks.append(sorted(best.items()))
        self.block_best = [dict(b) for b in blocks]
        self.bound = np.array([max(v for _, v in p) for p in self.postings], dtype=float)
        # Terms of least bound, as long as all of them together stay well below the least score:
        # alone they make no hit, so they open no window.
        order = np.argsort(self.bound, kind="stable")
        total = np.cumsum(self.bound[order])
        weak = order[: int(np.searchsorted(total, LEAST_SCORE * WEAK_SHARE))]
        self.weak_total = float(self.bound[weak].sum())
        strong = np.ones(len(self.postings), dtype=bool)
        strong[weak] = False
        counts = np.array([len(b) if s else 0 for b, s in zip(blocks, strong)], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        flat = [x for b, s in zip(blocks, strong) if s for x in b]
        self.flat_block = np.array([x[0] for x in flat], dtype=np.int64)
        self.flat_best = np.array([x[1] for x in flat], dtype=float)


def wand(shard: Shard, terms: list[int], least: float) -> list[tuple[int, float]]:
    """All items that the terms score at ``least`` or more, by block-max WAND.

    Cursors stand in item order. The pivot is the first item that the bounds of the lists up to it
    can lift over ``least``; if the maxima of its blocks cannot, all lists go to the next block at once.
    """
    out = []
    # [item under the cursor, term, position]
    cursors = [[shard.items[t][0], t, 0] for t in terms]
    bound, slack = shard.bound, 1e-9
    while cursors:
        cursors.sort()
        total, pivot = 0.0, -1
        for at, (_, t, _) in enumerate(cursors):
            total += bound[t]
            if total >= least - slack:
                pivot = at
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block = item // BLOCK
        if sum(shard.block_best[t].get(block, 0.0) for _, t, _ in cursors[: pivot + 1]) < least - slack:
            # no item of this block before the next list's item can be a hit
            goal = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                goal = min(goal, cursors[pivot + 1][0])
            moved = range(pivot + 1)
        elif cursors[0][0] == item:
            score = math.fsum(shard.impacts[t][p] for i, t, p in cursors[: pivot + 1])
            if score >= least - slack:
                out.append((item, score))
            goal, moved = item + 1, range(pivot + 1)
        else:
            goal, moved = item, range(pivot + 1)
        for at in moved:
            cursor = cursors[at]
            items = shard.items[cursor[1]]
            if cursor[0] < goal:
                cursor[2] = bisect_left(items, goal, cursor[2])
                cursor[0] = items[cursor[2]] if cursor[2] < len(items) else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return out


def open_windows(shard: Shard, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(text, start) of the windows in which some block's maxima, summed over all words, reach the least score.

    ``ids`` holds term numbers (-1: none) of all texts in turn. A window spans two strides, so that
    any ``span`` words lie whole in one.
    """
    stride = shard.span
    per_text = np.maximum(1, -(-lengths // stride) - 1)
    strong = (ids >= 0) & (shard.first[ids + 1] > shard.first[ids])
    first_text = 0
    while first_text < len(lengths):
        # as many texts as fit into a table of windows and blocks of bounded size
        ends = np.cumsum(per_text[first_text:])
        n_texts = max(1, int(np.searchsorted(ends, CELLS // shard.n_blocks, side="right")))
        texts = slice(first_text, first_text + n_texts)
        first_window = np.concatenate([[0], ends[:n_texts]])
        low, high = starts[first_text], starts[texts][-1] + lengths[texts][-1]
        hit = low + np.flatnonzero(strong[low:high])
        text = np.searchsorted(starts[texts], hit, side="right") - 1
        place = (hit - starts[texts][text]) // stride
        pairs = []
        for window in (place, place - 1):
            inside = (window >= 0) & (window < per_text[texts][text])
            pairs.append((first_window[text[inside]] + window[inside]) * len(shard.bound) + ids[hit[inside]])
        # a word counts once in a window
        row, term = np.divmod(np.unique(np.concatenate(pairs)), len(shard.bound))
        n = shard.first[term + 1] - shard.first[term]
        # the blocks of each term, laid side by side
        at = np.repeat(shard.first[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        sums = np.bincount(np.repeat(row, n) * shard.n_blocks + shard.flat_block[at], shard.flat_best[at], int(first_window[-1]) * shard.n_blocks)
        best = sums.reshape(-1, shard.n_blocks).max(axis=1)
        for w in np.flatnonzero(best + shard.weak_total >= LEAST_SCORE - 1e-9):
            i = int(np.searchsorted(first_window, w, side="right")) - 1
            yield first_text + i, int(w - first_window[i]) * stride
        first_text += n_texts


def runs_of(words: list[str]) -> frozenset:
    return frozenset(tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def found_in(shard: Shard, words: list[str], ids: np.ndarray, start: int) -> Iterator[tuple[int, float, float, float]]:
    """(item, score, question overlap, answer overlap) of the window's verified hits."""
    end = start + 2 * shard.span
    here = np.unique(ids[start:end])
    hits = wand(shard, here[here >= 0].tolist(), LEAST_SCORE)
    if not hits:
        return
    passage = words[start:end]
    by_length = {n: {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)} for n in {len(r) for i, _ in hits for side in shard.runs[i] for r in side}}
    share = lambda side: sum(r in by_length[len(r)] for r in side) / len(side) if side else None
    for item, score in hits:
        question, answer = (share(side) for side in shard.runs[item])
        if (question is None or question >= LEAST_OVERLAP) and (answer is None or answer >= LEAST_OVERLAP):
            yield item, score, question, answer


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, variant, text, answer, length, weights): an item's words with their BM25 impacts.

    Each different text and answer of an item_id is an item of its own, told apart by ``variant``.
    Impacts are shares of the item's own score. Document frequencies, the number of items and
    their mean length are taken over all items.
    """
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    id_type = items.schema["item_id"].dataType.simpleString()
    key = ["item_id", "variant"]
    rows = items.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer")).distinct()
    rows = rows.withColumn("variant", F.sha2(F.to_json(F.struct("text", "answer")), 256))

    def step():
        def work(part):
            out = {"item_id": [], "variant": [], "word": [], "tf": [], "length": []}
            for item, variant, text, answer in zip(part["item_id"], part["variant"], part["text"], part["answer"]):
                words = words_of(text) + words_of(answer or "")
                for w in sorted(set(words)):
                    for k, v in (("item_id", item), ("variant", variant), ("word", w), ("tf", words.count(w)), ("length", len(words))):
                        out[k].append(v)
            return out

        return work

    terms = in_batches(rows, f"item_id {id_type}, variant string, word string, tf int, length int", step)
    totals = terms.groupBy(*key).agg(F.max("length").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = totals["n"], totals["mean"] or 1.0
    df = terms.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scored = terms.join(df, "word").withColumn("impact", impact)
    own = scored.groupBy(*key).agg(F.max("length").alias("length"), F.sum("impact").alias("own"), F.sort_array(F.collect_list(F.struct("word", "impact"))).alias("weights"))
    return rows.join(own, key)


def shards(items: DataFrame) -> Iterator[list[Shard]]:
    """The index, one pass at a time: the driver holds no more than one pass's shards.

    A shard takes items of one length class, in order, up to ``SHARD_BYTES`` of their text.
    """
    span = F.pow(2, F.ceil(F.log2(F.greatest("length", F.lit(LEAST_SPAN))))).cast("int").alias("span")
    rows = item_terms(items).select("item_id", "text", "answer", "own", "weights", span).orderBy("span", "item_id", "variant")
    ready: list[Shard] = []
    now, held, total = None, 0, 0
    for r in rows.toLocalIterator():
        size = len(r["text"]) + len(r["answer"] or "")
        if now is None or r["span"] != now.span or held + size > SHARD_BYTES:
            if total + size > PASS_BYTES:
                yield ready
                ready, total = [], 0
            now, held = Shard([], r["span"]), 0
            ready.append(now)
        held, total = held + size, total + size
        number = len(now.item_ids)
        now.item_ids.append(r["item_id"])
        question, answer = parts_of(r["text"], r["answer"])
        now.runs.append((runs_of(question), runs_of(answer)))
        for word, impact in r["weights"]:
            term = now.terms.setdefault(word, len(now.terms))
            if term == len(now.postings):
                now.postings.append([])
            now.postings[term].append((number, impact / r["own"]))
    if ready:
        yield ready


def search(documents: DataFrame, index: list[Shard]) -> DataFrame:
    """Verified hits of all documents in the shards of one pass."""
    for shard in index:
        shard.seal()
    held = documents.sparkSession.sparkContext.broadcast(index)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "item_no", "shard", "score", "question_overlap", "answer_overlap", "first_word"]

    def step():
        def work(part):
            out = {c: [] for c in columns}
            split = [words_of(t.decode()) for t in part["text"]]
            lengths = np.array([len(w) for w in split], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            for k, shard in enumerate(held.value):
                term = shard.terms.get
                ids = np.fromiter((term(w, -1) for words in split for w in words), dtype=np.int64, count=int(lengths.sum()))
                best: dict[tuple[int, int], tuple] = {}
                for i, start in open_windows(shard, ids, starts, lengths):
                    for item, score, question, answer in found_in(shard, split[i], ids[starts[i] : starts[i] + lengths[i]], start):
                        key = (i, item)
                        if key not in best or (score, -start) > (best[key][0], -best[key][3]):
                            best[key] = (score, question, answer, start)
                for (i, item), (score, question, answer, start) in best.items():
                    for c, v in zip(columns, (part["doc_id"][i], item, k, score, question, answer, start)):
                        out[c].append(v)
            return out

        return work

    schema = f"doc_id {id_type}, item_no int, shard int, score double, question_overlap double, answer_overlap double, first_word long"
    hits = in_batches(documents.select("doc_id", utf8()), schema, step, "text")
    # the ids of the pass's items, as bounded as its shards
    first_id = next((i for s in index for i in s.item_ids), 0)
    names = local_rows(
        documents.sparkSession,
        [(k, n, i) for k, s in enumerate(index) for n, i in enumerate(s.item_ids)],
        f"shard int, item_no int, item_id {'string' if isinstance(first_id, str) else 'long'}",
    )
    return hits.join(F.broadcast(names), ["shard", "item_no"])


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of every verified hit.

    A passage is a window of a document's words, twice as long as the items of a shard; all
    passages that reach ``LEAST_SCORE`` of an item's own BM25 score are retrieved. A hit stands if
    the passage holds ``LEAST_OVERLAP`` of the five-word runs of the question, and of the answer
    (the item's last sentence where there is no column ``answer``). Of several passages of one
    document the best counts, ties to the first.

    Null or empty texts and items without words have no hits; rows without doc_id are searched and
    keep their null; items without id are left out, of a repeated item id each
    different text is looked for; repeated document rows count once. Empty tables give no rows; other columns are not looked at.
    """
    spark = documents.sparkSession
    found = None
    for index in shards(items):
        hits = search(documents, index)
        found = hits if found is None else found.union(hits)
    if found is None:
        id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((documents, "doc_id"), (items, "item_id")))
        return spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, score double, question_overlap double, answer_overlap double, first_word long")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "question_overlap", "answer_overlap")).alias("best")
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap", (-F.col("best.back")).alias("first_word"))
    )
