"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


UNROLLED = 256  # dimensions up to which a product is one expression of generated code


def dot(vector: Column, query: list[float]) -> Column:
    if len(query) <= UNROLLED:
        total = F.lit(0.0)
        for k, x in enumerate(query):
            total = total + F.get(vector, F.lit(k)).cast("double") * F.lit(float(x))
        return total
    other = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, other, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def normalised(vector: Column) -> Column:
    """Unit length; a zero or non-finite vector is an error."""
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = (total > 0) & (total < F.lit(float("inf")))
    return F.when(good, F.transform(vector, lambda x: x / F.sqrt(total))).otherwise(F.raise_error(F.lit("zero or non-finite vector")).cast("array<double>"))
