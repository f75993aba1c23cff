"""Vector functions as Column expressions over arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

L2, COSINE = "l2_unit", "cosine"
#: Digits of a distance that decide the order; ids decide beyond them.
ORDER_DIGITS = 9


def literal(vector: Sequence[float]) -> Column:
    """A constant array, folded once into the plan instead of a cross join."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length in double precision; a zero vector stays as it is."""
    whole = F.transform(a, lambda x: x.cast("double"))
    return let(whole, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def rounded(a: Column, digits: int) -> Column:
    """The elements to a number of digits, half away from zero; what rounds to zero keeps its sign, as in SQL engines that
    round doubles (Spark goes through a decimal, which has no negative zero)."""
    scale = F.lit(10.0**digits)

    def one(x: Column) -> Column:
        r = F.round(x * scale) / scale
        return F.when(r == 0, x * F.lit(0.0)).otherwise(r)

    return F.transform(a, one)


def distance(a: Column, query: Sequence[float], metric: str = L2) -> Column:
    """Of the vectors to one query: Euclidean between unit vectors (0 to 2), or one minus the cosine (0 to 2).

    A zero vector stays zero under the first metric; under the second its distance is null."""
    length = sum(float(x) * float(x) for x in query) ** 0.5
    unit = [float(x) / length if length else float(x) for x in query]
    product = lambda v: dot(v, literal(unit))
    if metric == L2:
        # |a/|a| - q|^2 = 2 - 2 cos; where one of them is zero only the other's square is left.
        one = 1.0 if length else 0.0
        return let(a, lambda v: let(norm(v), lambda n: F.when(n == 0, F.lit(one)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0 + one) - 2 * product(v) / n)))))
    if metric == COSINE:
        if not length:
            return F.lit(None).cast("double")
        return let(a, lambda v: let(norm(v), lambda n: F.when(n == 0, F.lit(None).cast("double")).otherwise(1 - product(v) / n)))
    raise ValueError(f"no such metric: {metric}")


def relevance(d: Column) -> Column:
    """1 for distance 0, 0 for distance 2."""
    return 1 - d / 2
