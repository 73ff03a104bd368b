"""Scans without a bound on their look back over long series: segments of days are scanned apart and hand on a small state.

A symbol is as many tasks as it has segments. What a segment adds is one row per symbol and segment: its sum, or its first and last value
and the length of its last run. A running total over these few rows is what each segment starts from. All is lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of a segment.
DAYS = 1000


def in_segments(rows: DataFrame, days: int = DAYS) -> DataFrame:
    return rows.withColumn("__seg", F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / days).cast("int"))


def joined(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state: one row per symbol and segment, __symbol, __segment, others."""
    return rows.join(state, F.col("symbol").eqNullSafe(F.col("__symbol")) & (F.col("__seg") == F.col("__segment")), "left").drop("__symbol", "__segment")


def running_sum(rows: DataFrame, x: Column, name: str, days: int = DAYS) -> DataFrame:
    """rows (symbol, date, others) with the sum of x, whole numbers, up to each row; missing values add nothing."""
    rows = in_segments(rows.withColumn("__x", F.coalesce(x, F.lit(0)).cast("long")), days)
    before = W.partitionBy("symbol").orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    state = rows.groupBy("symbol", "__seg").agg(F.sum("__x").alias("all"))
    state = state.select(F.col("symbol").alias("__symbol"), F.col("__seg").alias("__segment"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("__before"))
    inside = F.sum("__x").over(W.partitionBy("symbol", "__seg").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return joined(rows.withColumn("__in", inside), state).withColumn(name, F.col("__in") + F.col("__before")).drop("__x", "__seg", "__in", "__before")


def before(rows: DataFrame, value: str, name: str, days: int = DAYS) -> DataFrame:
    """rows (symbol, date, value, others) with the value of the row before, null for a symbol's first: a segment's first row takes the last one of the segment before."""
    rows = in_segments(rows, days)
    own = W.partitionBy("symbol", "__seg").orderBy("date")
    state = rows.groupBy("symbol", "__seg").agg(F.max_by(value, "date").alias("last"))
    state = state.select(F.col("symbol").alias("__symbol"), F.col("__seg").alias("__segment"), F.lag("last").over(W.partitionBy("symbol").orderBy("__seg")).alias("__handed"))
    rows = joined(rows.withColumn("__first", F.row_number().over(own) == 1).withColumn("__in", F.lag(value).over(own)), state)
    return rows.withColumn(name, F.when(F.col("__first"), F.col("__handed")).otherwise(F.col("__in"))).drop("__seg", "__first", "__in", "__handed")


def run_length(rows: DataFrame, value: str, days: int = DAYS) -> DataFrame:
    """rows (symbol, date, value, others) with __run, the length so far of the run of equal values, and __last and __last_run, value and length of
    the row before; values are not null.

    A segment of one value goes on the run of the segment before, if that ends with the value; so lengths add up over such segments.
    """
    rows = in_segments(rows, days)
    own = W.partitionBy("symbol", "__seg").orderBy("date")
    turn = F.coalesce(F.col(value) != F.lag(value).over(own), F.lit(True)).cast("int")
    rows = rows.withColumn("__k", F.sum(turn).over(own.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy("symbol", "__seg", "__k").orderBy("date")))
    state = rows.groupBy("symbol", "__seg").agg(F.min_by(value, "date").alias("first"), F.max_by(value, "date").alias("last"), F.max_by("__n", "date").alias("tail"), (F.max("__k") == 1).alias("even"))
    series = W.partitionBy("symbol").orderBy("__seg")
    goes_on = F.coalesce(F.col("even") & (F.lag("last").over(series) == F.col("first")), F.lit(False))
    state = state.withColumn("chain", F.sum((~goes_on).cast("int")).over(series.rowsBetween(W.unboundedPreceding, 0)))
    upto = W.partitionBy("symbol", "chain").orderBy("__seg").rowsBetween(W.unboundedPreceding, 0)
    state = state.withColumn("length", F.sum("tail").over(upto))  # an even segment's last run is all of it
    state = state.select(F.col("symbol").alias("__symbol"), F.col("__seg").alias("__segment"), F.lag("last").over(series).alias("__old"), F.lag("length").over(series).alias("__old_run"))
    rows = joined(rows, state)
    more = (F.col("__k") == 1) & (F.col("__old") == F.col(value))
    rows = rows.withColumn("__run", F.col("__n") + F.when(more, F.col("__old_run")).otherwise(0))
    out = rows.withColumn("__last", F.coalesce(F.lag(value).over(own), F.col("__old"))).withColumn("__last_run", F.coalesce(F.lag("__run").over(own), F.col("__old_run")))
    return out.drop("__seg", "__k", "__n", "__old", "__old_run")
