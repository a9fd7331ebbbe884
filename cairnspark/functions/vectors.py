"""Vector metrics as column expressions; all arithmetic in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | Sequence[float]


def vec(v: Vector) -> Column:
    """A column as array<double>, or a literal vector."""
    return v.cast("array<double>") if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Vector, b: Vector) -> Column:
    return _total(F.zip_with(vec(a), vec(b), lambda x, y: x * y))


def l2_squared(a: Vector, b: Vector) -> Column:
    """Squared Euclidean distance (no root)."""
    return _total(F.zip_with(vec(a), vec(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Vector) -> Column:
    return F.sqrt(_total(F.transform(vec(a), lambda x: x * x)))


def cosine(a: Vector, b: Vector) -> Column:
    """Cosine similarity; 0 if a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def dot_int(a: Column, b: Column) -> Column:
    """Integer dot product of quantised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def l2_squared_int(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def score(metric: str, a: Vector, b: Vector) -> Column:
    """The score a user sees: squared distance, or similarity."""
    return {"l2": l2_squared, "cosine": cosine, "dot": dot}[metric](a, b)


def sort_key(metric: str, shown: Column) -> Column:
    """Smaller is nearer."""
    return shown if metric == "l2" else -shown


def report(metric: str, key: Column) -> Column:
    """The score behind a :func:`sort_key`."""
    return key if metric == "l2" else -key


def normalize(a: Vector) -> Column:
    """Unit length; the zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(vec(a), lambda x: x / n)).otherwise(vec(a))


def max_sim(metric: str, query: Column, tokens: Column) -> Column:
    """Sum over query tokens of the best similarity to a document token; 0 if either has none."""
    best = lambda t: F.array_max(F.transform(tokens, lambda u: score(metric, t, u)))
    sims = F.aggregate(query, F.lit(0.0), lambda s, t: s + F.coalesce(best(t), F.lit(0.0)))
    return F.when((F.size(query) > 0) & (F.size(tokens) > 0), sims).otherwise(F.lit(0.0))


def check_dim(v: Column, dim: int) -> Column:
    """The vector, or an error if its length is not ``dim``."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vector has not {dim} components but "), F.size(v).cast("string"))))
