"""Highest and lowest values, sums and counts of the last w rows at a cost that does not grow with w.

Rows are cut into blocks of w. A window of w rows is the end of one block and the start of the next, or a whole block, so its value is made of
two running ones: forwards from the start of a block, and backwards from its end. Each row hands the second to the row w - 1 places on, where
one grouping brings both together; the first row of a block hands on nothing, as the block's last row has all of it. A symbol is as many tasks
as it has blocks; nothing scans a symbol as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moving(rows: DataFrame, w: int, values: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """rows (symbol, rn from 0 without gaps, others) with columns {name: (aggregate, value)} over the last w rows; null where fewer than w rows are there.

    Aggregates are F.max, F.min and F.sum: those that parts of a window add up to. Missing values are passed over.
    """
    blocks = rows.select(F.struct(*rows.columns).alias("__own"), "symbol", F.col("rn").alias("__rn"), F.floor(F.col("rn") / w).alias("__block"), *[x.alias(f"__{c}") for c, (_, x) in values.items()])
    own = W.partitionBy("symbol", "__block")
    so_far = lambda order: own.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    for side, order in (("start", F.col("__rn").asc()), ("end", F.col("__rn").desc())):
        blocks = blocks.select("*", *[f(f"__{c}").over(so_far(order)).alias(f"__{side}_{c}") for c, (f, _) in values.items()])
    first = F.col("__rn") == F.col("__block") * w
    here = F.struct(F.col("__rn").alias("__at"), F.col("__own").alias("__row"), *[F.col(f"__start_{c}").alias(c) for c in values])
    ahead = F.struct((F.col("__rn") + w - 1).alias("__at"), F.lit(None).cast(blocks.schema["__own"].dataType).alias("__row"), *[F.when(~first, F.col(f"__end_{c}")).alias(c) for c in values])
    both = blocks.select(F.col("symbol").alias("__symbol"), F.inline(F.array(here, ahead)))
    met = both.groupBy("__symbol", "__at").agg(F.first("__row", ignorenulls=True).alias("__row"), *[f(c).alias(c) for c, (f, _) in values.items()])
    return met.where("__row is not null").select("__row.*", *[F.when(F.col("__at") >= w - 1, F.col(c)).alias(c) for c in values])


def moving_extremes(rows: DataFrame, w: int, highest: dict[str, Column], lowest: dict[str, Column]) -> DataFrame:
    return moving(rows, w, {**{c: (F.max, x) for c, x in highest.items()}, **{c: (F.min, x) for c, x in lowest.items()}})


def moving_moments(rows: DataFrame, w: int, values: dict[str, Column]) -> DataFrame:
    """rows with mean_c and std_c, sample deviation, of whole numbers c over the last w rows, from exact sums; null unless w values are known."""
    big = {c: x.cast("decimal(19,0)") for c, x in values.items()}
    parts = {k: v for c, x in big.items() for k, v in {f"__n_{c}": (F.sum, x.isNotNull().cast("long")), f"__s_{c}": (F.sum, x), f"__q_{c}": (F.sum, (x * x).cast("decimal(38,0)"))}.items()}
    out, cols = moving(rows, w, parts), {}
    for c in values:
        n, s, q = F.col(f"__n_{c}"), F.col(f"__s_{c}").cast("decimal(38,0)"), F.col(f"__q_{c}").cast("decimal(38,0)")
        spread = (q * F.lit(w)).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
        cols |= {f"mean_{c}": F.when(n == w, s.cast("double") / F.lit(float(w)))}
        if w > 1:
            cols |= {f"std_{c}": F.when(n == w, F.sqrt(spread.cast("double") / F.lit(float(w * (w - 1)))))}
    return out.withColumns(cols).drop(*parts)
