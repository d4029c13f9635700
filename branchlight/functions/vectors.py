"""Vector expressions over array<double> columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column | str) -> Column:
    """V3: as doubles, so that arithmetic never happens in single precision."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column | str) -> Column:
    """V1: v over its length; a zero vector stays. The length is bound once by the outer transform, not once per element."""
    one = F.transform(F.array(doubles(v)), lambda w: F.struct(w.alias("w"), F.sqrt(dot(w, w)).alias("n")))
    return F.element_at(F.transform(one, lambda s: F.when(s["n"] > 0, F.transform(s["w"], lambda x: x / s["n"])).otherwise(s["w"])), 1)


def distance(a: Column, b: Column) -> Column:
    """V2: Euclidean; summed differences, since sqrt(2 - 2 cos) cancels near 0 and is wrong for centroids."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def project(v: Column, mean: Column, components: Column) -> Column:
    """R2: (v - mean) times each component."""
    return F.transform(components, lambda c: F.aggregate(F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero makes -0.0 equal 0.0."""
    return F.round(x, digits) + F.lit(0.0)
