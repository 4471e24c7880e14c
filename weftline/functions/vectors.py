"""Column functions over vectors (arrays of numbers), computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for different dimensions and for a zero vector."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), 0.0).otherwise(dot(a, b) / length)


def euclidean(a: Column, b: Column) -> Column:
    """Infinite for different dimensions."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(F.sqrt(_sum(squares)))


def truncate(a: Column, dims: int) -> Column:
    """The first ``dims`` dimensions, or all if there are fewer."""
    return F.slice(a, 1, dims)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A vector in [-1, 1] that depends on the text's hash alone."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.pmod(F.xxhash64(text, i), F.lit(2001)) - 1000) / 1000.0)


def text_statistics(text: Column) -> Column:
    """Shares of kinds of characters and lengths: the reproducible part of a content embedding."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return F.array(F.length(text) / 10000.0, share("[A-Z]"), share("[a-z]"), share("[0-9]"), share(r"\s"), share(r"[^\sA-Za-z0-9]"), F.regexp_count(text, F.lit("\n")) / 1000.0)
