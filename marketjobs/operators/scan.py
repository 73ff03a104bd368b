"""Exponentially weighted means as chunked scans of windows, without Python and without joins.

s_t = d * s_(t-1) + u_t is, within a chunk, d^k times a running sum of u * d^-k; chunks are short, so the powers stay far from
overflow. What comes in from before a chunk is the last value of the chunk before, that of the one before it times the decay of a chunk, and so
on; a chunk's decay is so strong that a few of these terms are all that a double can hold. All windows are by symbol in order of
date, so they share one shuffle and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chunks import by_chunks
from ..functions.rolling import KEEP, div, lag, rnd, roll, series
from .volatility import with_range

CHUNK = 256


def scan(df: DataFrame, columns: dict[str, tuple[Column, float]], chunk: int = CHUNK) -> DataFrame:
    """df (symbol, date, others) with the scans of columns: name -> (u, not null; d)."""
    own = series("symbol", "__c")
    t = F.row_number().over(series()) - 1
    out = df.select("*", F.floor(t / chunk).alias("__c"), (t % chunk).cast("double").alias("__k"), *[u.alias(f"__u_{n}") for n, (u, _) in columns.items()])
    k = F.col("__k")
    inside = {n: F.pow(F.lit(d), k) * F.sum(F.col(f"__u_{n}") * F.pow(F.lit(d), -k)).over(own.rowsBetween(W.unboundedPreceding, 0)) for n, (_, d) in columns.items()}
    out = out.select("*", *[x.alias(f"__s_{n}") for n, x in inside.items()])
    before, terms = series().rowsBetween(W.unboundedPreceding, -1), {n: max(1, math.ceil(18 / -math.log10(d**chunk))) for n, (_, d) in columns.items()}
    for i in range(max(terms.values())):
        last = lambda n: F.last(F.when(k == chunk - 1, F.col(f"__e{i - 1}_{n}" if i else f"__s_{n}")), ignorenulls=True).over(before)  # noqa: B023, E731
        out = out.select("*", *[last(n).alias(f"__e{i}_{n}") for n in columns if i < terms[n]])

    def whole(n: str, d: float) -> Column:
        carried = sum((F.coalesce(F.col(f"__e{i}_{n}"), F.lit(0.0)) * F.lit(d ** (chunk * i)) for i in range(1, terms[n])), F.coalesce(F.col(f"__e0_{n}"), F.lit(0.0)))
        return F.col(f"__s_{n}") + F.pow(F.lit(d), k + 1) * carried

    return out.select(*[F.col(c) for c in df.columns], *[whole(n, d).alias(n) for n, (_, d) in columns.items()])


def ema(x: Column, span: int) -> tuple[Column, float]:
    """Of scan: the recursive form, whose first value is x itself."""
    alpha = 2.0 / (span + 1)
    return F.when(F.row_number().over(series()) == 1, x).otherwise(x * alpha), 1.0 - alpha


def weighted(df: DataFrame, columns: dict[str, Column], alpha: float) -> DataFrame:
    """df with means of the columns by weights (1 - alpha)^age, normalised; null on the first row, where they are unknown."""
    d = 1.0 - alpha
    out = scan(df, {n: (F.coalesce(x, F.lit(0.0)), d) for n, x in columns.items()})
    m = F.row_number().over(series()) - 1
    mean = lambda n: F.when(m > 0, F.col(n) * (1.0 - d) / (1.0 - F.pow(F.lit(d), m.cast("double"))))
    return out.select(*df.columns, *[mean(n).alias(n) for n in columns])


def macd(bars: DataFrame, keep=KEEP) -> DataFrame:
    """MACD of closes in cents, its signal line from the rounded MACD, and both over the close."""
    close = F.col("close").cast("double")
    out = scan(bars, {"__e12": ema(close, 12), "__e26": ema(close, 26)}).withColumn("__macd", rnd(F.col("__e12") - F.col("__e26"), 3))
    out = scan(out, {"__signal": ema(F.col("__macd"), 9)})
    return out.select(*keep, rnd(div(F.col("__macd"), F.col("close")), 4).alias("macd"), rnd(div(F.col("__signal"), F.col("close")), 4).alias("macd_signal"))


def adx(bars: DataFrame, w: int = 14, keep=KEEP) -> DataFrame:
    """Directional indices over the average range, their contrast, and its mean of w rows."""
    up = F.greatest(F.col("high") - lag("high"), F.lit(0)).cast("double")
    down = F.abs(F.least(F.col("low") - lag("low"), F.lit(0))).cast("double")
    rows = with_range(bars).select(*dict.fromkeys([*keep, "symbol", "date"]), (roll(F.sum, F.col("tr"), w).cast("double") / float(w)).alias("__atr"), up.alias("__up"), down.alias("__down"))
    first = F.row_number().over(series()) == 1
    rows = weighted(rows, {"__u": F.when(~first, F.col("__up")), "__d": F.when(~first, F.col("__down"))}, 1.0 / w)
    plus, minus = div(F.col("__u"), F.col("__atr")) * 100, div(F.col("__d"), F.col("__atr")) * 100
    rows = rows.withColumns({"__plus": plus, "__minus": minus})
    rows = rows.withColumn("__dx", div(F.abs(F.col("__plus") - F.col("__minus")), F.col("__plus") + F.col("__minus")) * 100)
    return rows.select(*keep, rnd(F.col("__plus"), 3).alias("plus_di"), rnd(F.col("__minus"), 3).alias("minus_di"), rnd(roll(F.avg, F.col("__dx"), w), 3).alias("adx"))


#: Rows before a chunk after which nothing of an older row is left in a double: weights of the slowest mean here, 1/14 a row, fall to 10^-33.
LOOK_BACK = 1024


def macd_long(bars: DataFrame, chunk: int = LOOK_BACK, look_back: int = LOOK_BACK) -> DataFrame:
    """macd for symbols of any length: chunks start their means `look_back` rows early. Rows are read 1 + look_back / chunk times."""
    return by_chunks(bars, macd, look_back, chunk)


def adx_long(bars: DataFrame, chunk: int = LOOK_BACK, look_back: int = LOOK_BACK) -> DataFrame:
    """adx for symbols of any length, in the same way."""
    return by_chunks(bars, adx, look_back, chunk)
