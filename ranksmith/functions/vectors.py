"""Dense vector column functions (ARRAY<FLOAT|DOUBLE>), JVM side.

Spark 4.1 has no vector dot product, so these are higher-order functions.
Arithmetic is in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda is evaluated again for every element; as the
    argument of an outer one-element lambda it is a variable."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def l2_normalize(a) -> Column:
    """Divide by the L2 norm so that dot = cosine; a zero vector stays zero."""
    return bind(l2_norm(a), lambda n: F.transform(
        _c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def log_sum_exp(a) -> Column:
    """log(sum(exp(x))) of an array, shifted by its largest element (empty: null)."""
    return bind(F.array_max(_c(a)), lambda m: m + F.log(F.aggregate(
        _c(a), F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))
