"""Column expressions shared by every operator.

Everything here builds a Catalyst expression; nothing runs per row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a column name look like an identifier.
ID_NAME_PATTERN = (
    "id|codigo|código|cod_|^cod|cedula|cédula|dni|ruc|uuid|"
    "tramite|trámite|secuencia|numero|número"
)
# The shorter list used when picking columns to simulate.
SIMULATION_ID_PATTERN = "id|cedula|cédula|codigo|código"

# Severity ranks; any other text ranks 1.
SEVERITY_RANKS = {"high": 3, "medium": 2}

# Strength bands of |r|, strongest first.
STRENGTH_BANDS = [
    (0.90, "very_strong"),
    (0.70, "strong"),
    (0.50, "moderate"),
    (0.30, "low"),
]

# Row-count bands and the number of clusters for each.
CLUSTER_BANDS = [(300, 3), (3_000, 4), (20_000, 5)]
CLUSTERS_BEYOND_BANDS = 6

NEAR_ZERO = 1e-9


def col(name: str) -> Column:
    """A top-level column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(name: str) -> Column:
    return col(name).cast("double")


def is_finite(c: Column) -> Column:
    # NaN is greater than infinity; short code, since columns times measures soon outgrow what the JVM compiles
    return c.isNotNull() & (F.abs(c) < F.lit(float("inf")))


def finite(c: Column) -> Column:
    """The value when it is a finite number, otherwise null."""
    return F.when(is_finite(c), c)


def clamp(c: Column, low, high) -> Column:
    # least and greatest skip nulls, so a missing value would come out as a bound.
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def share(part: Column, whole: Column) -> Column:
    """Percentage of ``part`` in ``whole``; 0 when ``whole`` is 0."""
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0)) * 100.0).otherwise(0.0)


def zscore(c: Column, mean: float, std: float, bound: float = 8.0) -> Column:
    """Bounded z-score; a missing or non-finite value counts as the mean (0)."""
    score = (c - F.lit(mean)) / F.lit(std)
    return F.when(is_finite(c), F.greatest(F.lit(-bound), F.least(F.lit(bound), score))).otherwise(0.0)


def severity_rank(c: Column) -> Column:
    rank = F.lit(1)
    for name, value in SEVERITY_RANKS.items():
        rank = F.when(c == name, value).otherwise(rank)
    return rank


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    band = F.lit("very_low")
    for floor, name in reversed(STRENGTH_BANDS):
        band = F.when(size >= floor, F.lit(name)).otherwise(band)
    sign = F.when(r > 0, "positive").when(r < 0, "negative").otherwise("none")
    return F.concat_ws("_", band, sign)


def cluster_count(rows: Column) -> Column:
    """Number of clusters for a row count, never more than one per 20 rows (but at least 2)."""
    base = F.lit(CLUSTERS_BEYOND_BANDS)
    for below, k in reversed(CLUSTER_BANDS):
        base = F.when(rows < below, F.lit(k)).otherwise(base)
    room = F.greatest(F.floor(rows / 20), F.lit(2))
    return F.greatest(F.least(base, room), F.lit(2)).cast("int")


def looks_like_id(name: Column) -> Column:
    return F.lower(name).rlike(ID_NAME_PATTERN)


def looks_like_id_for_simulation(name: Column) -> Column:
    return F.lower(name).rlike(SIMULATION_ID_PATTERN)


def relative_range(low: Column, mid: Column, high: Column) -> Column:
    spread = F.abs(high - low)
    return F.when(F.abs(mid) > NEAR_ZERO, spread / F.abs(mid)).otherwise(spread)


def variation_coefficient(std: Column, mean: Column) -> Column:
    return F.when(F.abs(mean) > NEAR_ZERO, F.abs(std / F.abs(mean))).otherwise(F.abs(std))


def html_text(c: Column) -> Column:
    # "&" has to go first, or it would escape the other replacements again.
    out = c
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def fixed_decimals(c: Column, digits: int) -> Column:
    """Number with a fixed count of decimals; blank when null or not finite."""
    return F.coalesce(F.when(is_finite(c), F.format_string(f"%.{digits}f", c)), F.lit(""))


def whole_number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def abbreviate(c: Column, length: int) -> Column:
    return F.when(F.char_length(c) <= length, c).otherwise(
        F.concat(F.left(c, F.lit(max(length - 1, 0))), F.lit("…"))
    )


def keep_first(items: list[Column]) -> Column:
    """Array of the non-null entries, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
