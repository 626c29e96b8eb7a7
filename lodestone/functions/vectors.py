"""Vector expressions over arrays of floats; sums run in doubles, in the order of the components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def is_unit(a, dimensions: int) -> Column:
    """Right length, all components finite, squared norm within 0.001 of one."""
    a = _col(a)
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    square = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(a) == dimensions) & finite & (F.abs(square - 1) < 0.001), F.lit(False))


def normalize(a) -> Column:
    """To unit length: the norm in doubles, the result in floats; null for zero and non-finite vectors."""
    a, n = _col(a), norm(a)
    return F.when((n > 0) & (n < F.lit(float("inf"))), F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def project(a, dimensions: int) -> Column:
    """The first components, normalized again."""
    return normalize(F.slice(_col(a), 1, dimensions))
