"""Array-vector expressions, evaluated row by row inside the JVM (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sum of element products, left to right. Unequal widths are an error; a null element
    gives null."""
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    total = F.aggregate(prods, F.lit(0.0), lambda acc, p: acc + p)
    wrong = F.raise_error(F.lit("vectors of unequal width")).cast("double")
    return F.when(F.size(_c(a)) != F.size(_c(b)), wrong).otherwise(total)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double_array(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; null when either side has zero norm (NumPy would give NaN)."""
    denom = l2_norm(a) * l2_norm(b)
    return F.when(denom > 0, dot(a, b) / denom)


def euclidean(a, b) -> Column:
    diffs = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x - y)
    return F.sqrt(F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d * d))
