"""Vector distances as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions up to which a product with a literal is spelt out, so that it compiles with its stage.
UNROLLED = 256


def _terms(v: Column, q: list[float], term) -> Column:
    if len(q) <= UNROLLED:
        out = F.lit(0.0)
        for i, x in enumerate(q):
            out = out + term(F.get(v, F.lit(i)).cast("double"), F.lit(float(x)))
        return out
    pairs = F.zip_with(v, F.array(*[F.lit(float(x)) for x in q]), lambda a, b: term(a.cast("double"), b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(v: Column, q: list[float]) -> Column:
    return _terms(v, q, lambda a, b: a * b)


def norm(v: Column, dims: int) -> Column:
    if dims <= UNROLLED:
        out = F.lit(0.0)
        for i in range(dims):
            x = F.get(v, F.lit(i)).cast("double")
            out = out + x * x
        return F.sqrt(out)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(v: Column, q: list[float]) -> Column:
    return 1 - F.try_divide(dot(v, q), norm(v, len(q)) * math.sqrt(sum(x * x for x in q)))


def l2_distance(v: Column, q: list[float]) -> Column:
    return F.sqrt(_terms(v, q, lambda a, b: (a - b) * (a - b)))


def pair_cosine(a: Column, b: Column) -> Column:
    """Of two array columns."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(total(a, b), F.sqrt(total(a, a)) * F.sqrt(total(b, b)))


def relevance(distance: Column, metric: str) -> Column:
    """Distance to relevance."""
    if metric == "cosine":
        return 1 - distance
    if metric == "l2":
        return 1 - distance / math.sqrt(2)
    if metric == "ip":
        return F.when(distance > 0, 1 - distance).otherwise(-distance)
    raise ValueError(f"unknown metric {metric}")


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    d = v.cast("array<double>")
    length = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.element_at(F.transform(F.array(length), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(x))), 1)
