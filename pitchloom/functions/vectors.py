"""Fixed-length feature vectors held as ``array<double>`` columns.

Row-local: nothing in this module shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three channels of a feature vector, in storage order.
CHANNELS = ("nyas", "duration", "stable")
BINS = 120


def channel(features: Column, k: int, width: int = BINS) -> Column:
    return F.slice(features, 1 + width * k, width)


def channels(features: Column, width: int = BINS, names: Sequence[str] = CHANNELS) -> Column:
    """``array<struct(channel, values)>``, one entry per channel."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("channel"), channel(features, k, width).alias("values"))
            for k, n in enumerate(names)
        ]
    )


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NaN when either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def has_nan(a: Column) -> Column:
    return F.exists(a, F.isnan)


def has_inf(a: Column) -> Column:
    return F.exists(a, lambda x: F.abs(x) == float("inf"))


def sums_to_zero(a: Column) -> Column:
    return total(a) == 0


def all_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def nonzero_count(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x > 0))


def argmax(a: Column) -> Column:
    """Index of the largest element, the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_k(a: Column, k: int = 5) -> Column:
    """The ``k`` largest elements as ``array<struct(value, bin)>``.

    On ties the higher index comes first.
    """
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("value"), i.alias("bin")))
    return F.slice(F.sort_array(pairs, asc=False), 1, k)
