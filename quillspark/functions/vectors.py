"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where one is the zero vector."""
    norms = dot(a, a) * dot(b, b)
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.sqrt(norms))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def quantised(v: Column, least: Column, step: Column) -> Column:
    """Each component to -128..127 by its dimension's least value and step."""
    return F.transform(F.arrays_zip(v.alias("x"), least.alias("lo"), step.alias("step")), lambda t: (F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round((t["x"].cast("double") - t["lo"]) / t["step"]))) - 128).cast("int"))


def restored(q: Column, least: Column, step: Column) -> Column:
    return F.transform(F.arrays_zip(q.alias("q"), least.alias("lo"), step.alias("step")), lambda t: (t["q"] + 128) * t["step"] + t["lo"])


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def rough_cosine(a: Column, b: Column) -> Column:
    """From quantised vectors, in 0..1."""
    return (int_dot(a, b) / (F.size(a) * 16384.0) + 1) / 2
