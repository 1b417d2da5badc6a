"""Sums of doubles without rounding error, so that means don't hang on the order of additions.

Every value is scaled to 1 at most by a power of two and cut into whole numbers of 18 bits, whose sums
are exact in 64 bits for up to 2**45 rows and merge in any order. The first three hold the 52 bits below
the largest value, two more the 36 bits after those; what is smaller still is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from .measures import measure

HIGH, LOW, LIMB = 52, 36, 18
LEAST_EXPONENT = -1000
COLUMNS_PER_SCAN = 2
# Bits kept of the plain mean around which squares are taken: as good a centre, but a stable one.
CENTRE_BITS = 44


def cut(c: Column) -> tuple[Column, Column]:
    """The whole-number parts of a value from -1 to 1: of 52 bits, signed, and of the 36 bits after them."""
    high = F.floor(c * 2.0**HIGH)
    return high, F.floor((c * 2.0**HIGH - high) * 2.0**LOW)


def limb_sums(high: Column, low: Column) -> list[Column]:
    mask = (1 << LIMB) - 1
    limbs = [F.shiftright(high, 2 * LIMB), F.shiftright(high, LIMB).bitwiseAND(mask), high.bitwiseAND(mask), F.shiftright(low, LIMB), low.bitwiseAND(mask)]
    return [F.sum(x) for x in limbs]


def total_of(limbs: list[int]) -> Fraction:
    a, b, c, d, e = (int(x or 0) for x in limbs)
    return Fraction((a << 2 * LIMB) + (b << LIMB) + c, 1 << HIGH) + Fraction((d << LIMB) + e, 1 << (HIGH + LOW))


@dataclass
class Moments:
    mean: float
    variance: float


def exponent_of(top: float) -> int:
    return max(math.frexp(top)[1], LEAST_EXPONENT)


def centre_of(mean: float, exponent: int) -> float:
    """The mean in scaled units, with its first bits only."""
    scaled = mean * 2.0**-exponent if math.isfinite(mean) else 0.0
    part, e = math.frexp(scaled)
    return math.ldexp(round(part * 2**CENTRE_BITS), e - CENTRE_BITS)


def exact_moments(frame: DataFrame, known: dict[str, tuple[int, float, float, float]]) -> dict[str, Moments]:
    """Mean and population variance of double columns with only finite values and nulls.

    ``known`` has (non-null rows, any near mean, least, greatest value) of each column. The mean is
    the double nearest to the true one, up to 2**-88 of the largest value. Squares are taken around
    the near mean and added up without error, so that the variance is stable too.
    """
    answer, wanted = {}, {}
    for name, (n, mean, low, high) in known.items():
        if n and low == high:
            answer[name] = Moments(low, 0.0)
        elif n:
            e = exponent_of(max(abs(low), abs(high)))
            centre = centre_of(mean, e)
            spread = exponent_of(max(high * 2.0**-e - centre, centre - low * 2.0**-e))
            wanted[name] = (n, e, centre, spread)
    if not wanted:
        return answer
    parts, sums = [], []
    for i, (name, (_, e, centre, spread)) in enumerate(wanted.items()):
        value = col(name) * 2.0**-e
        away = (value - centre) * 2.0**-spread
        for kind, c in (("v", value), ("s", away * away)):
            high, low = cut(c)
            parts += [high.alias(f"{kind}{i}"), low.alias(f"{kind}{i}_")]
        sums.append([s for kind in "vs" for s in limb_sums(F.col(f"{kind}{i}"), F.col(f"{kind}{i}_"))])
    groups = [[s for group in sums[i : i + COLUMNS_PER_SCAN] for s in group] for i in range(0, len(sums), COLUMNS_PER_SCAN)]
    row = iter([x for found in measure(frame.select(*parts), groups, "bigint") for x in found])
    for name, (n, e, centre, spread) in wanted.items():
        first, squares = total_of([next(row) for _ in range(5)]) / n, total_of([next(row) for _ in range(5)]) / n
        variance = max(squares * Fraction(4) ** spread - (first - Fraction(centre)) ** 2, Fraction(0))
        answer[name] = Moments(_scaled(first, e), _scaled(variance, 2 * e))
    return answer


def _scaled(x: Fraction, exponent: int) -> float:
    try:
        return float(x * Fraction(2) ** exponent)
    except OverflowError:
        return math.inf
