"""Vector functions over array columns, in double precision.

A zero vector has no direction: its cosine is null, so that no threshold lets it through (NaN would
compare as greater than any number).
"""

from __future__ import annotations

from pyspark.sql import functions as F


def as_double(v):
    return v.cast("array<double>")


def dot(a, b):
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v):
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b, norm_a=None, norm_b=None):
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return dot(a, b) / F.nullif(size, F.lit(0.0))


def l2(a, b):
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def literal(values):
    return F.lit([float(x) for x in values]).cast("array<float>")


def checked(v, dim: int):
    """The vector, or an error if it doesn't have ``dim`` components."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"embedding dimension is not {dim}: "), F.size(v).cast("string"))))


def batches(values, size: int):
    """An array cut in arrays of ``size``."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / F.lit(size)) - 1, F.lit(0)).cast("int"))
    return F.filter(F.transform(starts, lambda i: F.slice(values, i * size + 1, F.lit(size))), lambda b: F.size(b) > 0)
