"""Vector functions as column expressions; all arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    n = norm(v)
    return F.transform(_double(v), lambda x: F.when(n == 0, x).otherwise(x / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def is_usable(v: str, dim: str) -> Column:
    """Not null, of the given width, without null, NaN or infinite numbers, and not all zero."""
    # array_contains is null, not false, where an element is null and none is NaN
    whole = (F.size(v) == F.col(dim)) & ~F.array_contains(v, F.lit(float("nan")).cast("float"))
    return F.coalesce(F.col(v).isNotNull() & whole & (F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf")) & ((F.array_max(v) != 0) | (F.array_min(v) != 0)), F.lit(False))
