"""Toxicity scores by a sparse logistic model, trained so that swapped identity terms leave scores alone."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Frames, in_batches, utf8, with_python_column

# Documented bounds of the training: features that the model may hold, labelled rows it is fitted
# on, and rounds of the fit.
MAX_FEATURES = 4096
FIT_ROWS = 40_000
ROUNDS = 200

# Parameters of the fit: the cost of large weights, the cost of score changes under a swap, and the
# fewest toxic rows that hold a feature.
RIDGE = 1e-3
SWAP_COST = 1.0
LEAST_TOXIC = 8
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
SEED = 7
# Words whose features a worker keeps.
KEPT_WORDS = 200_000

# Terms that name groups of people, in sets whose members can stand for each other. A parameter.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("africans", "europeans", "asians", "americans"),
    ("immigrants", "natives"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
)

WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def features_of(words: Iterable[str]) -> set[str]:
    """Whole words, and beginnings of longer words, which stand for a stem with its endings."""
    found = set(words)
    for n in PREFIXES:
        found.update([w[:n] + "*" for w in words if len(w) > n])
    return found


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    swap_gap: float = 0.0


class Scorer:
    """Looks every different word of a worker's texts up once: its own weight and the known beginnings."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def look(self, word: str) -> tuple:
        have = self.model.weights
        hits = ((word,) if word in have else ()) + tuple(x for n in PREFIXES if len(word) > n and (x := word[:n] + "*") in have)
        if len(self.seen) >= KEPT_WORDS:
            self.seen.clear()
        self.seen[word] = hits
        return hits

    def score(self, text: str) -> float:
        """The probability of the label 1; an empty text gets what the bias alone says."""
        seen, hits = self.seen, set()
        for w in words_of(text):
            found = seen[w] if w in seen else self.look(w)
            if found:
                hits.update(found)
        total = self.model.bias + math.fsum(self.model.weights[x] for x in hits)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def training_rows(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled ids that are not held out.

    A hash of the doc_id picks them, toxic or not. Only their ids and labels,
    which the bound limits, are sent to where the texts are; no text is shuffled.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1))
    y = y.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    n = y.count()
    if n > rows:
        # 0.95 keeps the count below the bound
        y = y.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000_000)) < int(0.95e9 * rows / n))
    return documents.select("doc_id", utf8()).join(F.broadcast(y), "doc_id")


def choose_features(rows: DataFrame, identity: Iterable[str]) -> tuple[list[str], list[int]]:
    """Features that tell the labels apart best, counted over all ``rows``; and (rows, toxic rows)."""

    def step():
        def work(part):
            count: dict[str, list[int]] = {}
            for text, y in zip(part["text"], part["y"]):
                for f in features_of(words_of(text.decode())):
                    got = count.setdefault(f, [0, 0])
                    got[0] += 1
                    got[1] += y
            return {"feature": list(count), "n": [v[0] for v in count.values()], "toxic": [v[1] for v in count.values()]}

        return work

    counts = in_batches(rows, "feature string, n long, toxic long", step, "text").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    n, toxic = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not toxic or toxic == n:
        return [], [n, toxic]
    base = toxic / n
    rate = (F.col("toxic") + base) / (F.col("n") + 1)
    gain = F.col("toxic") * F.log(rate / F.lit(base))
    # a feature must be far likelier among toxic rows than chance makes any of so many features
    best = (
        counts.where((F.col("toxic") >= min(LEAST_TOXIC, max(2, toxic // 20))) & (rate >= min(0.9, 3 * base)))
        .orderBy(F.desc(gain), "feature")
        .limit(MAX_FEATURES)
        .select("feature")
        .collect()
    )
    names = [r["feature"] for r in best]
    return names + sorted(set(identity) - set(names)), [n, toxic]


def swapped(words: set[str], sets_of: dict[str, tuple[str, ...]], pick: random.Random) -> set[str] | None:
    """The words with every identity term replaced by another of its set; None if there is none."""
    terms = words & sets_of.keys()
    if not terms:
        return None
    return words - terms | {pick.choice([x for x in sets_of[t] if x != t]) for t in sorted(terms)}


def fit(texts: list[str], labels: list[int], features: list[str], identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, swap_cost: float = SWAP_COST) -> Model:
    """Logistic regression on presence of features, with ridge and with a cost on swap gaps.

    For each labelled text with identity terms a copy with swapped terms is made. The cost adds
    ``swap_cost`` times the mean squared difference of the two scores before the logistic curve.
    """
    number = {f: i for i, f in enumerate(features)}
    pick = random.Random(SEED)
    sets_of = {t: s for s in identity for t in s}
    columns, starts, gap_rows = [], [0], []
    for text in texts:
        words = words_of(text)
        at = {number[f] for f in features_of(words) if f in number}
        columns += sorted(at)
        starts.append(len(columns))
        other = swapped(words, sets_of, pick)
        if other is not None:
            there = {number[f] for f in features_of(other) if f in number}
            if at != there:
                gap_rows.append((sorted(at - there), sorted(there - at)))
    cols, starts = np.array(columns, dtype=np.int64), np.array(starts)
    row_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    y = np.array(labels, dtype=float)
    gap_col = np.array([c for a, b in gap_rows for c in a + b], dtype=np.int64)
    gap_sign = np.array([s for a, b in gap_rows for s in [1.0] * len(a) + [-1.0] * len(b)])
    gap_of = np.array([i for i, (a, b) in enumerate(gap_rows) for _ in a + b], dtype=np.int64)
    n, m, gaps = len(texts), len(features), len(gap_rows)
    w, bias = np.zeros(m), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else 0.0
    square, bias_square = np.full(m, 1e-8), 1e-8
    weight = np.where(y > 0, max(1.0, 0.25 * n / max(1.0, y.sum())), 1.0)
    for _ in range(ROUNDS):
        z = bias + np.bincount(row_of, w[cols], n) if len(cols) else np.full(n, bias)
        off = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        gradient = (np.bincount(cols, off[row_of], m) if len(cols) else np.zeros(m)) + RIDGE * w / 10
        if gaps and swap_cost:
            gap = np.bincount(gap_of, gap_sign * w[gap_col], gaps)
            gradient += 2 * swap_cost / gaps * np.bincount(gap_col, gap_sign * gap[gap_of], m)
        square += gradient**2
        bias_square += off.sum() ** 2
        w -= 0.5 * gradient / np.sqrt(square)
        bias -= 0.5 * off.sum() / math.sqrt(bias_square)
    left = float(np.mean(np.abs(np.bincount(gap_of, gap_sign * w[gap_col], gaps)))) if gaps else 0.0
    return Model(float(bias), {f: float(v) for f, v in zip(features, w) if abs(v) > 1e-6}, left)


def train(documents: DataFrame, labels: DataFrame, identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, swap_cost: float = SWAP_COST) -> Model:
    """The model of the labelled rows that are not held out, of which it sees ``FIT_ROWS`` at most.

    Of each such row only the words that a chosen feature needs come to the driver, at most
    ``FIT_ROWS`` short word lists. Without labelled rows of both kinds the model is the share of
    toxic rows.
    """
    frames = Frames(documents.sparkSession)
    rows = frames.keep(training_rows(documents, labels))
    terms = {t for s in identity for t in s}
    features, (n, toxic) = choose_features(rows, terms)
    if not features:
        share = (toxic + 0.01) / (n + 1)
        return Model(math.log(share / max(1e-6, 1 - share)))
    known = frozenset(features)

    def step():
        def work(part):
            kept = []
            for text in part["text"]:
                words = words_of(text.decode())
                kept.append(" ".join(sorted(w for w in words if w in known or any(len(w) > k and w[:k] + "*" in known for k in PREFIXES))))
            return {"doc_id": part["doc_id"], "y": part["y"], "words": kept}

        return work

    id_type = rows.schema["doc_id"].dataType.simpleString()
    sample = in_batches(rows.select("doc_id", "text", "y"), f"doc_id {id_type}, y int, words string", step, "text").collect()
    frames.release()
    sample.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["words"]))
    return fit([r["words"] for r in sample], [r["y"] for r in sample], features, identity, swap_cost)


def score_documents(documents: DataFrame, labels: DataFrame, identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, from the whole text.

    Labels come only from rows whose crc32(doc_id as text) mod 3 is not 1; a null label is no label,
    of repeated labels the larger counts. Null or empty texts are scored by the bias; a null doc_id
    is not held out and not learned from; repeated rows are scored each; no documents give no rows.
    Label, language, source and id are no input of a score; other columns are not looked at.
    """
    return scores(documents, train(documents, labels, identity), threshold)


def with_score(documents: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """The documents, all their columns, and the score of each whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def step():
        scorer = Scorer(held.value)
        return lambda texts: [scorer.score(t.decode()) for t in texts]

    return with_python_column(documents, name, "double", step)


def scores(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    scored = with_score(documents.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
