"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_draw(key: Column) -> Column:
    """Deterministic 60-bit integer from the SHA-256 of a string key."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """Stable for large |x|."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def safe_ratio(top: Column, bottom: Column, zero: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(zero))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return safe_ratio(F.size(F.array_intersect(left, right)).cast("double"), F.size(F.array_union(left, right)).cast("double"))


def _poisson_cuts() -> list[int]:
    """Cut-offs of all counts that a 60-bit draw can have."""
    cuts, term, total = [], math.exp(-1), 0.0
    while (cut := int((total + term) * (1 << 60))) < 1 << 60:
        cuts.append(cut)
        total += term
        term /= len(cuts)
    return cuts


#: Draws at or above the k-th cut-off have a Poisson(1) count over k.
POISSON_CUTS = _poisson_cuts()


def poisson_one(draw: Column) -> Column:
    """Poisson(1) count of a 60-bit draw, by integer cut-offs of the distribution function."""
    return sum((F.when(draw >= F.lit(c), 1).otherwise(0) for c in POISSON_CUTS), F.lit(0))
