"""Column functions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def l2_normalize(v: Column) -> Column:
    """A vector of length one; a vanishing vector is divided by 1e-12."""
    length = F.array(F.greatest(norm(v), F.lit(1e-12)))  # as a variable of the outer function it is worked out once a vector
    return F.element_at(F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def first_pool(matrix: Column) -> Column:
    """The first token's vector, normalized."""
    return l2_normalize(F.element_at(matrix, 1))


def mean_pool(matrix: Column, mask: Column) -> Column:
    """The mean of the unmasked tokens' vectors (not normalized); no tokens count as 1e-9."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    pairs = F.zip_with(matrix, mask, lambda row, m: F.transform(row, lambda x: x.cast("double") * m.cast("double")))
    zero = F.transform(F.element_at(matrix, 1), lambda x: F.lit(0.0))
    total = F.aggregate(pairs, zero, lambda s, row: F.zip_with(s, row, lambda x, y: x + y))
    return F.transform(total, lambda x: x / weight)
