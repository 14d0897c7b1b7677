"""Vector expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v) -> Column:
    return F.array(*(F.lit(float(x)) for x in v)).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def l2(a: Column, b: Column, squared: bool = False) -> Column:
    """Euclidean distance; null if the lengths differ."""
    d = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(a) == F.size(b), d if squared else F.sqrt(d))


def cosine(a: Column, b: Column) -> Column:
    """0 on different lengths, empty vectors or a zero norm."""
    a, b = doubles(a), doubles(b)
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def shift(v: Column, by: Column) -> Column:
    """v plus by, element by element, as far as by goes."""
    return F.transform(doubles(v), lambda x, i: x + F.coalesce(F.try_element_at(doubles(by), (i + 1).cast("int")), F.lit(0.0)))


def scale(v: Column, by) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def to_float32(v: Column) -> Column:
    return v.cast("array<float>")
