"""Windows over a symbol's rows in date order, and the arithmetic of a panel: half-even rounding, division without errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Columns that an operator on bars hands on; with all columns of the bars instead, operators follow each other without a join.
KEEP = ("symbol", "date")


def series(*keys: str, by: str = "date"):
    return W.partitionBy(*(keys or ("symbol",))).orderBy(by)


def last(w: int, *keys: str):
    """The row and the w - 1 before it."""
    return series(*keys).rowsBetween(-(w - 1), 0)


def upto(*keys: str):
    return series(*keys).rowsBetween(W.unboundedPreceding, 0)


def roll(agg: Callable[[Column], Column], x: Column, w: int) -> Column:
    """Null until the frame has w values."""
    return F.when(F.count(x).over(last(w)) == w, agg(x).over(last(w)))


def mean(x: Column, w: int) -> Column:
    return roll(F.sum, x, w).cast("double") / F.lit(float(w))


def std_exact(x: Column, w: int) -> Column:
    """Sample deviation of whole numbers from exact sums."""
    big = x.cast("decimal(19,0)")
    s, q = roll(F.sum, big, w).cast("decimal(38,0)"), roll(F.sum, (big * big).cast("decimal(38,0)"), w).cast("decimal(38,0)")
    spread = (q * F.lit(w)).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
    return F.sqrt(spread.cast("double") / F.lit(float(w * (w - 1))))


def std(x: Column, w: int) -> Column:
    return roll(F.stddev_samp, x, w)


def zscore(x: Column, w: int) -> Column:
    """Of doubles that are rounded to whole steps by the caller or compared with a tolerance."""
    return div(x - roll(F.avg, x, w), std(x, w))


def z_exact(x: Column, w: int) -> Column:
    """Score of whole numbers among the last w, from exact sums."""
    return div(x - mean(x, w), std_exact(x, w))


def steps(x: Column, n: int) -> Column:
    """Whole number of steps of 10^-n, half to even."""
    return F.rint(x * F.lit(10.0**n)).cast("long")


def lag(x: Column | str, n: int = 1, *keys: str) -> Column:
    return F.lag(x, n).over(series(*keys))


def lead(x: Column | str, n: int = 1, *keys: str) -> Column:
    return F.lead(x, n).over(series(*keys))


def rnd(x: Column, n: int) -> Column:
    """Half to even."""
    return F.rint(x * F.lit(10.0**n)) / F.lit(10.0**n)


def div(a: Column, b: Column) -> Column:
    """a / b as double; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def flag(cond: Column) -> Column:
    """1 where cond holds, 0 where it does not or is unknown."""
    return F.when(cond, 1).otherwise(0)


def without_inf(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with infinite values of the columns replaced by 0; missing ones stay missing."""
    return df.withColumns({c: clean_inf(F.col(c)) for c in columns})


def rounded(df: DataFrame, n: int = 2) -> DataFrame:
    """df with all its fractional columns rounded."""
    return df.withColumns({f.name: rnd(F.col(f.name), n) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def clean_inf(x: Column, fill: float = 0.0) -> Column:
    return F.when(F.abs(x) == float("inf"), F.lit(fill)).otherwise(x)
