"""Vector expressions on ``ARRAY<FLOAT>`` columns, with one policy for the odd cases.

A vector is *usable* if it has exactly ``dim`` numbers, all finite, and is not all zero. Products run
in double precision. The cosine with a zero vector is 0; with a null or a vector of another length
it is null. Ranking is by the score rounded to six digits, then by lower id, so that results do
not depend on the order of a sum. NaN never ranks (Spark would put it first).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64
DIGITS = 6


def doubles(v: Column | str) -> Column:
    """The numbers as doubles (half and single precision widen without loss)."""
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def finite(v: Column | str) -> Column:
    """True if no number is null, NaN or infinite."""
    inf = float("inf")
    return F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (x < F.lit(inf)) & (x > F.lit(-inf)), F.lit(False)))


def usable(v: Column | str, dim: int = DIM) -> Column:
    """One pass: the squared norm is null, NaN or infinite if a number is, and 0 if all are (squares of floats neither overflow nor vanish)."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(v) == dim) & square.between(5e-324, 1.7e308), F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, not once for each use of it."""
    return F.transform(F.array(value), body)[0]


def normalise(v: Column | str) -> Column:
    """The vector at length one, in doubles; a zero vector stays zero."""
    v = F.col(v) if isinstance(v, str) else v
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / F.nullif(n, F.lit(0.0))).otherwise(F.lit(0.0))))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0))))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).otherwise(n)


def literal(v) -> Column:
    """A query vector as a constant array, at length one (the plan then folds its norm away)."""
    n = sum(float(x) ** 2 for x in v) ** 0.5
    return F.expr("array(" + ",".join(f"{float(x) / n if n else 0.0!r}D" for x in v) + ")")


def score_to(v: Column | str, query) -> Column:
    """Rounded cosine of a stored vector to one query vector."""
    n = norm(v)
    return F.round(F.when(n > 0, dot(v, literal(query)) / F.nullif(n, F.lit(0.0))).otherwise(F.lit(0.0)), DIGITS)


def disc(v: Column | str, width: int) -> Column:
    """A square image in rows of ``width`` numbers: 0 outside the largest disc that fits into it."""
    mid, r2 = (width - 1) / 2, (width / 2) ** 2
    inside = lambda i: (F.pmod(i, F.lit(width)) - mid) * (F.pmod(i, F.lit(width)) - mid) + (F.floor(i / width) - mid) * (F.floor(i / width) - mid) <= r2
    return F.transform(v, lambda x, i: F.when(inside(i), x.cast("double")).otherwise(F.lit(0.0)))


def resize(v: Column | str, width: int, to: int) -> Column:
    """A square image in rows of ``width`` numbers at ``to`` x ``to`` numbers, bilinear between pixel centres."""
    v = F.col(v) if isinstance(v, str) else v
    at = lambda k: F.least(F.greatest((k + 0.5) * (width / to) - 0.5, F.lit(0.0)), F.lit(float(width - 1)))

    def pixel(i: Column) -> Column:
        y, x = at(F.floor(i / to)), at(F.pmod(i, F.lit(to)))
        y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
        y1, x1 = F.least(y0 + 1, F.lit(width - 1)), F.least(x0 + 1, F.lit(width - 1))
        p = lambda a, b: F.get(v, a * width + b).cast("double")
        top = p(y0, x0) + (p(y0, x1) - p(y0, x0)) * (x - x0)
        low = p(y1, x0) + (p(y1, x1) - p(y1, x0)) * (x - x0)
        return top + (low - top) * (y - y0)

    return F.transform(F.sequence(F.lit(0), F.lit(to * to - 1)), pixel)


def stretch(v: Column | str, low: float = 0.01, high: float = 0.99) -> Column:
    """Robust scaling to 0..1 between two percentiles; a flat vector gives zeros, never NaN.

    Percentiles interpolate linearly between the sorted numbers.
    """
    v = F.col(v) if isinstance(v, str) else v

    def at(s: Column, p: float) -> Column:
        pos = (F.size(s) - 1) * F.lit(p)
        lo = F.floor(pos).cast("int")
        hi = F.least(lo + 1, F.size(s) - 1)
        return F.get(s, lo) + (F.get(s, hi) - F.get(s, lo)) * (pos - lo)

    def scale(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.transform(v, lambda x: F.when(b > a, F.least(F.greatest((x.cast("double") - a) / F.nullif(b - a, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)))

    ends = let(F.array_sort(doubles(v)), lambda s: F.struct(at(s, low).alias("a"), at(s, high).alias("b")))
    return let(ends, scale)
