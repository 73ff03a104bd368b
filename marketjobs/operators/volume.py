"""Volume indicators. Volumes are whole, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import by_chunks
from ..functions.rolling import KEEP, div, lag, mean, rnd, roll, std_exact, steps, upto, z_exact
from ..functions.segments import DAYS, running_sum

#: Rows of a chunk of a long symbol.
CHUNK = 1000


def up_down() -> tuple[Column, Column]:
    c, p = F.col("close"), F.col("prev")
    return F.when(c > p, F.col("volume")).otherwise(0), F.when(c < p, F.col("volume")).otherwise(0)


def obv(bars: DataFrame, windows=(5, 10), z: int = 42, keep=KEEP) -> DataFrame:
    """On-balance volume, its rate of change and scores; the sum itself is replaced by its z-score."""
    up, down = up_down()
    return obv_scores(bars.withColumn("prev", lag("close")).withColumn("obv", F.sum(up - down).over(upto())), windows, z, keep)


def obv_scores(out: DataFrame, windows=(5, 10), z: int = 42, keep=KEEP) -> DataFrame:
    cols = [x for w in windows for x in (rnd(div(F.col("obv") - lag("obv", w), lag("obv", w)), 6).alias(f"obv_roc_{w}"), rnd(div(F.col("obv") - mean(F.col("obv"), w), std_exact(F.col("obv"), w)), 6).alias(f"obv_z_{w}"))]
    return out.select(*keep, *cols, rnd(div(F.col("obv") - mean(F.col("obv"), z), std_exact(F.col("obv"), z)), 6).alias("obv"))


def vol_ratio(bars: DataFrame, windows=(10, 25, 50, 100), z: int = 42, keep=KEEP) -> DataFrame:
    """Volume of rising over falling days, 0 where unknown, warm-up included; and its score, from millionths."""
    out = bars.withColumn("prev", lag("close"))
    up, down = up_down()
    out = out.withColumn("up", up).withColumn("down", down)
    out = out.select("*", *[F.coalesce(steps(div(roll(F.sum, F.col("up"), w), roll(F.sum, F.col("down"), w)), 6), F.lit(0)).alias(f"__r{w}") for w in windows])
    ratio = lambda w: F.col(f"__r{w}")
    return out.select(*keep, *[x for w in windows for x in ((ratio(w) / F.lit(1e6)).alias(f"vol_ratio_{w}"), rnd(z_exact(ratio(w), z), 6).alias(f"vol_ratio_{w}_z"))])


def flow() -> Column:
    """Money flow of a day: volume times the place of the close between low and high, from -1 to 1; none where these are equal."""
    place = div(F.lit(2) * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low"))
    return F.coalesce(place * F.col("volume"), F.lit(0.0))


def cmf(bars: DataFrame, windows=(10, 20), keep=KEEP) -> DataFrame:
    out = bars.withColumn("flow", flow())
    return out.select(*keep, *[rnd(div(roll(F.sum, F.col("flow"), w), roll(F.sum, F.col("volume"), w)), 6).alias(f"cmf_{w}") for w in windows])


def adl(bars: DataFrame, z: int = 42, keep=KEEP) -> DataFrame:
    """Accumulation and distribution: the running sum of the flow, each day's rounded to thousandths, which sum exactly; and its score."""
    return adl_scores(bars.select("*", F.sum(steps(flow(), 3)).over(upto()).alias("__adl")), z, keep)


def adl_scores(out: DataFrame, z: int = 42, keep=KEEP) -> DataFrame:
    return out.select(*keep, (F.col("__adl") / F.lit(1000.0)).alias("adl"), rnd(z_exact(F.col("__adl"), z), 6).alias("adl_z"))


def obv_long(bars: DataFrame, z: int = 42, chunk: int = CHUNK, days: int = DAYS) -> DataFrame:
    """obv for symbols of any length: what looks back a bounded number of rows is done in chunks, the sum in segments that hand on theirs."""
    up, down = up_down()
    signed = by_chunks(bars, lambda rows: rows.withColumn("prev", lag("close")).select("symbol", "date", (up - down).alias("signed")), 1, chunk)
    return by_chunks(running_sum(signed, F.col("signed"), "obv", days), lambda rows: obv_scores(rows, z=z), z - 1, chunk)


def adl_long(bars: DataFrame, z: int = 42, chunk: int = CHUNK, days: int = DAYS) -> DataFrame:
    """adl for symbols of any length, as obv_long."""
    summed = running_sum(bars, steps(flow(), 3), "__adl", days).select("symbol", "date", "__adl")
    return by_chunks(summed, lambda rows: adl_scores(rows, z), z - 1, chunk)


def vroc(bars: DataFrame, windows=(3, 5, 10), keep=KEEP) -> DataFrame:
    return bars.select(*keep, *[rnd(div(F.col("volume") - lag("volume", w), lag("volume", w)), 6).alias(f"vroc_{w}") for w in windows])


def vol_spike(bars: DataFrame, windows=(10, 20), keep=KEEP) -> DataFrame:
    """Volume over its rolling median."""
    median = lambda w: roll(lambda x: F.percentile(x, F.lit(0.5)), F.col("volume"), w)
    return bars.select(*keep, *[rnd(div(F.col("volume"), median(w)), 6).alias(f"vol_spike_{w}") for w in windows])
