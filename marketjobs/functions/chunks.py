"""Operators with a bounded look back over long series: rows in chunks, each with the rows before it that its windows need.

A symbol with a very long history is then many tasks. Rows are numbered without a window over a whole symbol: counts per
stretch of days, a running sum over these few, and numbers within each stretch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRETCH_DAYS = 3650


def whole(*keys: str):
    """All rows of a key."""
    return W.partitionBy(*keys)


def numbered(rows: DataFrame, days: int = STRETCH_DAYS) -> DataFrame:
    """rows (symbol, date) with rn, from 0, in order of date within each symbol."""
    staged = rows.withColumn("__stretch", F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / days))
    before = W.partitionBy("s").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    starts = staged.groupBy(F.col("symbol").alias("s"), F.col("__stretch").alias("t")).agg(F.count("*").alias("n"))
    starts = starts.select("s", "t", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy("symbol", "__stretch").orderBy("date")) - 1
    joined = staged.withColumn("__in", inside).join(starts, (F.col("symbol") == F.col("s")) & (F.col("__stretch") == F.col("t")))
    return joined.select(*rows.columns, (F.col("__start") + F.col("__in")).alias("rn"))


def by_chunks(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], look_back: int, chunk: int, look_ahead: int = 0) -> DataFrame:
    """operator(rows), for operators whose values depend on at most `look_back` rows before and `look_ahead` rows after a row of its symbol."""
    n = numbered(rows)
    lo, hi = F.floor((F.col("rn") - look_ahead) / chunk), F.floor((F.col("rn") + look_back) / chunk)
    spread = n.withColumn("__chunk", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)))
    own = spread.select(F.concat_ws("\x1f", "symbol", F.col("__chunk").cast("string")).alias("symbol"), *[c for c in rows.columns if c != "symbol"])
    home = n.select(F.concat_ws("\x1f", "symbol", F.floor(F.col("rn") / chunk).cast("string")).alias("symbol"), "date")
    out = operator(own).join(home, ["symbol", "date"])
    return out.withColumn("symbol", F.split("symbol", "\x1f")[0])
