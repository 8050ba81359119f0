"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def normalize(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def shorten(v: Column, dims: int | None) -> Column:
    """The first components at unit length again; a length that is not shorter changes nothing."""
    if dims is None:
        return v
    head = F.slice(v, 1, dims)
    return F.when(F.size(v) <= dims, F.transform(v, lambda x: x.cast("double"))).otherwise(normalize(head))
