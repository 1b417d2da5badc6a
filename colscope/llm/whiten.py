"""Whitening of embeddings: Chebyshev-filtered subspace iteration over distributed passes of centred XᵀXQ.

The covariance is never formed. A pass multiplies it with a narrow block of vectors, one small sum per
task. Between passes the driver holds blocks of dimensions x block numbers: it runs the three-term
recurrence of a Chebyshev polynomial that damps the unwanted end of the spectrum, orthogonalises, and
takes Ritz values and residuals, until the residuals certify the wanted components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BATCH_BYTES, Frames

# The steps of the whole-number vectors, and the number of components.
STEPS, SHIFT = 1024, 100_000
COMPONENTS = 8

# Vectors iterated together; doubled when they don't converge, up to the number of dimensions.
BLOCK = 32
# The highest polynomial of a sweep, and how far it may lift the first component over the last wanted one.
MOST_DEGREE, MOST_LIFT = 40, 1e8
# The angle error that certifies a component (residual by gap), and the residuals, by the largest eigenvalue, at
# which sweeps may end where rounding keeps them from getting there.
TOLERANCE, ROUNDING = 1e-12, 1e-11
# Variances up to this share of the largest are no components.
NO_VARIANCE = 1e-10
SEED = 13
# Products of whole numbers below this stay in 64 bits; beyond it Python's integers are used.
SAFE = 1 << 62


@dataclass
class Whitening:
    """``components`` has a unit vector per column; ``errors`` bounds the angle of each to the true one."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    errors: np.ndarray
    passes: int
    identity_error: float = 0.0


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors in whole steps, of the rows that take part.

    Out are vectors that are null, empty, hold null or non-finite entries or entries without a
    64-bit x, and, where lengths differ, those that don't have the most frequent length (of equally
    frequent ones the largest). Null vec_ids and repeated rows stay.
    """
    v = F.col("embedding").cast("array<double>")
    fits = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**52)), F.lit(False))
    usable = embeddings.where(fits & (F.size(v) > 0))
    length = usable.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    usable = usable.where(F.size(v) == (length["d"] if length else 0))
    return usable.select("vec_id", F.transform(v, lambda c: F.floor(c * STEPS) + SHIFT).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, and their column ``x`` as a matrix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(batch.schema.names.index("x"))
        width = len(x.flatten()) // batch.num_rows
        rows = max(1, BATCH_BYTES // (8 * width))
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, part.column(part.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, without error."""
    if n * int(np.abs(x).max()) < SAFE and max(map(abs, sums)) < SAFE:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return from_mean(x, n, sums).astype(np.float64) / n


def square_sums(away: np.ndarray) -> list[int]:
    """The sum of the squares of every row, without error."""
    if int(np.abs(away).max()) ** 2 * away.shape[1] >= SAFE:
        away = away.astype(object)
    return (away * away).sum(axis=1).tolist()


def summed(frame: DataFrame, step: Callable[[np.ndarray], np.ndarray], columns: int) -> dict[int, list[float]]:
    """The matrices that ``step`` makes of slices of x, added up: row number to row. One matrix a task is shuffled."""
    fields = T.StructType.fromDDL("i int, part array<double>")

    def run(batches):
        total = None
        for _, x in matrices(batches):
            made = step(x)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], schema=to_arrow_schema(fields))

    sums = [F.sum(F.get("part", F.lit(j))) for j in range(columns)]
    found = frame.select("x").mapInArrow(run, fields).groupBy("i").agg(F.array(*sums).alias("row")).collect()
    return {r["i"]: r["row"] for r in found}


def count_and_sums(frame: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension; upper and lower halves are added up apart."""
    fields = T.StructType.fromDDL("i int, n bigint, high bigint, low bigint")

    def run(batches):
        for _, x in matrices(batches):
            columns = [range(x.shape[1]), [len(x)] * x.shape[1], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(fields))], schema=to_arrow_schema(fields))

    whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    rows = sorted(frame.select("x").mapInArrow(run, fields).groupBy("i").agg(*whole).collect())
    return int(rows[0]["n"]) if rows else 0, [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


class Passes:
    """Products of the covariance with a block of vectors, a pass over the data each."""

    def __init__(self, frame: DataFrame, n: int, sums: list[int]):
        self.frame, self.n, self.sums, self.made = frame, n, sums, 0

    def times(self, block: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums

        def step(x):
            rows = centred(x, n, sums)
            return rows.T @ (rows @ block)

        self.made += 1
        rows = summed(self.frame, step, block.shape[1])
        return np.array([rows[i] for i in range(len(block))]) / n


def ritz(block: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, with their vectors, the covariance times these, and the residuals."""
    inner = block.T @ times
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    block, times = block @ turn, times @ turn
    return values, block, times, np.linalg.norm(times - block * values, axis=0)


def angles(values: np.ndarray, residuals: np.ndarray, wanted: int) -> np.ndarray:
    """Bounds of the angles between the wanted Ritz vectors and true ones: residual by gap to the next value."""
    if len(values) == 1:
        return residuals
    steps = np.append(np.inf, -np.diff(values))
    gaps = np.minimum(steps, np.append(steps[1:], np.inf))
    return residuals[:wanted] / np.maximum(gaps[:wanted], np.finfo(float).tiny)


def degree_of(values: np.ndarray, wanted: int, worst: float) -> int:
    """The polynomial that takes the worst wanted error to the tolerance, within the bounds; 0 if none does.

    What lies below the smallest Ritz value is damped; a component grows by acosh of its mapped place a degree.
    """
    if values[-1] <= 0:
        return 2
    first, last = (math.acosh(max(1.0, 2 * values[i] / values[-1] - 1)) for i in (0, wanted - 1))
    if last < 1e-3:
        return 0
    needed = math.ceil((math.log(max(worst / TOLERANCE, 1)) + math.log(4)) / last)
    room = math.log(MOST_LIFT) / (first - last) if first > last else MOST_DEGREE
    return max(2, min(needed, MOST_DEGREE, int(room)))


def filtered(passes: Passes, values: np.ndarray, block: np.ndarray, times: np.ndarray, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance, times the block, scaled so that the first component keeps its length.

    The interval from 0 to the smallest Ritz value is mapped to [-1, 1].
    """
    half = max(values[-1], NO_VARIANCE * values[0]) / 2
    scale = half / (values[0] - half)
    first = scale
    before, now = block, (times - half * block) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (passes.times(now) - half * now) * (2 * after / half) - scale * after * before
        scale = after
    return now / np.linalg.norm(now, axis=0)


def leading(passes: Passes, dimensions: int, wanted: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of the covariance, with their vectors and the bounds of their errors.

    A block that doesn't get there is doubled; one as wide as the space needs a single pass.
    """
    random = np.random.default_rng(SEED)
    held = np.zeros((dimensions, 0))
    while True:
        block = min(block, dimensions)
        if block == dimensions:
            vectors = np.eye(dimensions)
        else:
            vectors = np.linalg.qr(np.hstack([held, random.standard_normal((dimensions, block - held.shape[1]))]))[0]
        values, vectors, times, residuals = ritz(vectors, passes.times(vectors))
        worst = math.inf
        while True:
            errors = angles(values, residuals, wanted)
            before, worst = worst, errors.max()
            rounding = worst > before / 4 and residuals[:wanted].max() <= ROUNDING * values[0]
            if worst <= TOLERANCE or rounding or block == dimensions:
                return values[:wanted], vectors[:, :wanted], errors
            degree = degree_of(values, wanted, worst)
            if not degree or worst > before / 2:
                break
            vectors = np.linalg.qr(filtered(passes, values, vectors, times, degree))[0]
            values, vectors, times, residuals = ritz(vectors, passes.times(vectors))
        held, block = vectors, 2 * block


def fit(frame: DataFrame, wanted: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The components of the vectors of ``whole_vectors``; None without vectors.

    Components without variance are left out, so equal vectors have none. Of a component's two
    signs the one is taken that makes its largest entry positive.
    """
    n, sums = count_and_sums(frame)
    if not n:
        return None
    passes = Passes(frame, n, sums)
    dimensions = len(sums)

    def spread(x):
        return (centred(x, n, sums) ** 2).sum().reshape(1, 1)

    trace = summed(frame, spread, 1)[0][0] / n
    values, vectors, errors = leading(passes, dimensions, min(wanted, dimensions), max(block, 2 * wanted))
    there = values > NO_VARIANCE * values[0] if trace > 0 else np.zeros(len(values), dtype=bool)
    values, vectors, errors = values[there], vectors[:, there], errors[there]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    model = Whitening(n, sums, trace, values, vectors, errors, passes.made)
    if len(values):
        model.identity_error = identity_error(frame, model)
    return model


def identity_error(frame: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    k = len(model.values)

    def step(x):
        made = projected(x, model)
        return np.vstack([made.T @ made, made.sum(axis=0)])

    rows = summed(frame, step, k)
    products, means = np.array([rows[i] for i in range(k)]) / model.n, np.array(rows[k]) / model.n
    return float(np.abs(products - np.outer(means, means) - np.eye(k)).max())


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components / np.sqrt(model.values)


def whitened(frame: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, deviation, whitened) of every vector of ``whole_vectors``.

    ``deviation`` is exact, the sum over the dimensions of (n * x - sums)². No model gives no rows.
    """
    kind = frame.schema["vec_id"].dataType.simpleString()
    fields = T.StructType.fromDDL(f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    if model is None:
        return frame.sparkSession.createDataFrame([], fields)

    def run(batches):
        out = to_arrow_schema(fields)
        for part, x in matrices(batches):
            away = pa.array(list(map(str, square_sums(from_mean(x, model.n, model.sums))))).cast(out[1].type)
            rows = pa.array(projected(x, model).tolist(), out[2].type)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index("vec_id")).cast(out[0].type), away, rows], schema=out)

    return frame.mapInArrow(run, fields)


def whiten_embeddings(embeddings: DataFrame, wanted: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """One row per vector that takes part and component: the whitened value, and figures of the whole.

    (vec_id, component, n, deviation, whitened, explained, identity_error). Which vectors take part is
    said in ``whole_vectors``; all of them are the fit list. Fewer dimensions, or fewer directions with
    variance, give fewer components; an empty table and a table of equal vectors give no rows. A
    deviation beyond 64 bits is null here; ``whitened`` has it in full.
    """
    frame = Frames(embeddings.sparkSession).keep(whole_vectors(embeddings))
    model = fit(frame, wanted, block)
    shares = (model.values / model.trace).tolist() if model else []
    return whitened(frame, model).select(
        "vec_id",
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        F.posexplode("whitened").alias("at", "whitened"),
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
