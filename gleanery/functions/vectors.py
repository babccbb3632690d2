"""Column expressions over ``array<float>`` vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def safe_norm(a: Column) -> Column:
    """Norm with the zero vector counted as length one, so it normalises to itself."""
    length = norm(a)
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def normalise(a: Column, length: Column | None = None) -> Column:
    """Unit vector; pass ``length`` as a materialised column to compute it once per row."""
    divisor = safe_norm(a) if length is None else length
    return F.transform(a, lambda x: x.cast("double") / divisor)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (safe_norm(a) * safe_norm(b))


def has_dimension(a: Column, dimension: int) -> Column:
    """True for a vector of finite numbers that fits an index of this dimension; null does not."""
    return F.coalesce(F.size(a) == dimension, F.lit(False)) & all_finite(a)


def all_finite(a: Column) -> Column:
    """True unless the vector is null or holds a null, NaN or infinite component."""
    return F.coalesce(
        F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        F.lit(False),
    )
