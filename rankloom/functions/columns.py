"""Column helpers with the engine's missing-value rule: NULL in, NULL out, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip(c: Column, lo: float, hi: float) -> Column:
    """least/greatest skip NULLs, so a missing value must be kept out of them."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def log1p_return(r: Column, bounds: Sequence[float] | None = None) -> Column:
    """ln(1 + r).  A total loss (-1) has no logarithm: it is the lower bound if there is one, else NULL; below -1 is NULL."""
    base = F.when(r > -1, F.log1p(r))
    if bounds is None:
        return base
    lo, hi = bounds
    return F.when(r == -1, F.lit(float(lo))).otherwise(clip(base, lo, hi))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation, NULL where a side is constant (the built-in raises there)."""
    o = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(o(F.covar_pop(x, y)), o(F.stddev_pop(x)) * o(F.stddev_pop(y)))


def rolling(fn, c: Column, n: int, key: str = "security_id", order: str = "date") -> Column:
    """fn over the last n records; NULL until all n have a value."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, fn(c).over(w))


def average_rank(c: Column, by: Sequence[str]) -> Column:
    """1-based rank, ties at their mean rank."""
    same = W.partitionBy(*by, c)
    return F.rank().over(W.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(same) - 1).cast("double") / F.lit(2.0)


def bucket(rank: Column, count: Column, n: int) -> Column:
    """Equal-count bucket 1..n of a 1-based rank; spreads the remainder (ntile would put it first)."""
    return (F.floor((rank.cast("long") - 1) * n / count) + 1).cast("int")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """For results that are compared: rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
