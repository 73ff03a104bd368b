"""Ranges and volatility, context indices and their forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import KEEP, div, lag, mean, rnd, roll, std, std_exact, steps, upto, z_exact
from ..functions.segments import DAYS, run_length


def with_range(bars: DataFrame) -> DataFrame:
    prev = lag("close")
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def atr(bars: DataFrame, windows=(7, 14, 21), z: int = 42, keep=KEEP) -> DataFrame:
    """Average true range and its score; sums of whole numbers, so the score is one of w-row sums."""
    out = with_range(bars).select(*keep, "tr", *[roll(F.sum, F.col("tr"), w).alias(f"s{w}") for w in windows])
    cols = [x for w in windows for x in (rnd(F.col(f"s{w}") / F.lit(float(w)), 4).alias(f"atr_{w}"), rnd(div(F.col(f"s{w}") - mean(F.col(f"s{w}"), z), std_exact(F.col(f"s{w}"), z)), 6).alias(f"atr_z_{w}"))]
    return out.select(*keep, *cols)


def volatility(bars: DataFrame, windows=(5, 10, 25), z: int = 42, keep=KEEP) -> DataFrame:
    """Deviation of daily returns and the close over it, in thousandths, and the scores of both; 0 where unknown."""
    out = bars.withColumn("ret", div(F.col("close") - lag("close"), lag("close")))
    out = out.select("*", *[steps(std(F.col("ret"), w), 3).alias(f"__v{w}") for w in windows])
    out = out.select("*", *[steps(div(F.col("close"), F.col(f"__v{w}") / F.lit(1000.0)), 0).alias(f"__p{w}") for w in windows])
    known = lambda x: F.coalesce(x, F.lit(0.0))
    cols = [
        x for w in windows for x in (
            known(F.col(f"__v{w}") / F.lit(1000.0)).alias(f"volatility_{w}"), known(rnd(z_exact(F.col(f"__v{w}"), z), 6)).alias(f"volatility_{w}_z"),
            known(rnd(z_exact(F.col(f"__p{w}"), z), 6)).alias(f"price_vol_ratio_{w}_z"))
    ]
    return out.select(*keep, *cols)


def context_features(context: DataFrame, names=("vx", "sk")) -> DataFrame:
    """Of the indices (a row a day, one series): changes over 1, 5 and 10 rows, side of the 3- to the 20-row average (-1 where unknown), deviation of 5 rows."""
    one = context.withColumn("symbol", F.lit("context"))
    cols = []
    for n in names:
        x = F.col(n)
        cols += [
            *[rnd(div(x - lag(n, d), lag(n, d)), 6).alias(f"{n}_change_{d}") for d in (1, 5, 10)],
            F.when(mean(x, 3) > mean(x, 20), 1).otherwise(-1).alias(f"{n}_cross"),
            rnd(std_exact(x, 5), 1).alias(f"{n}_std"),
        ]
    return one.select("date", *cols)


def with_context(bars: DataFrame, context: DataFrame, keep=KEEP) -> DataFrame:
    """bars with the context of the same date, then the last known one; context of days without a bar is never used."""
    names = [c for c in context.columns if c != "date"]
    joined = bars.join(context, "date", "left")
    return joined.select(*keep, *[F.last(n, ignorenulls=True).over(upto()).alias(n) for n in names])


def label_streak(labels: DataFrame) -> DataFrame:
    """symbol, date, label -> streak: length so far of the run of equal labels, negative for 0; and that of the row before, 0 first."""
    s = W.partitionBy("symbol").orderBy("date")
    turn = F.coalesce(F.col("label") != F.lag("label").over(s), F.lit(True)).cast("int")
    out = labels.where("label is not null").withColumn("run", F.sum(turn).over(s.rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("n", F.row_number().over(W.partitionBy("symbol", "run").orderBy("date")))
    out = out.withColumn("streak", F.when(F.col("label") == 1, F.col("n")).otherwise(-F.col("n")))
    return out.select("symbol", "date", "label", "streak", F.coalesce(F.lag("streak").over(s), F.lit(0)).alias("streak_before"))


def label_streak_long(labels: DataFrame, days: int = DAYS) -> DataFrame:
    """label_streak for symbols of any length: segments hand on the value and length of their last run."""
    rows = run_length(labels.where("label is not null").select("symbol", "date", "label"), "label", days)
    signed = lambda label, n: F.when(F.col(label) == 1, F.col(n)).otherwise(-F.col(n))
    return rows.select("symbol", "date", "label", signed("label", "__run").cast("int").alias("streak"), F.coalesce(signed("__last", "__last_run"), F.lit(0)).cast("int").alias("streak_before"))
