"""Oscillators and returns. Sums are over whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import KEEP, div, flag, lag, last, lead, mean, rnd, roll, std_exact, steps, z_exact


def rsi(bars: DataFrame, periods=(14, 21), steps=(1, 3, 5), keep=KEEP) -> DataFrame:
    """Relative strength with simple means; an unknown change counts as none; no loss gives 100, neither gain nor loss null."""
    out = bars.select(*keep, *[(F.col("close") - lag("close", d)).alias(f"d{d}") for d in steps])
    cols = []
    for p in periods:
        for d in steps:
            gain = F.sum(F.when(F.col(f"d{d}") > 0, F.col(f"d{d}")).otherwise(0)).over(last(p))
            loss = F.sum(F.when(F.col(f"d{d}") < 0, -F.col(f"d{d}")).otherwise(0)).over(last(p))
            full = F.count("*").over(last(p)) == p
            cols.append(F.when(full, rnd(div(F.lit(100) * gain, gain + loss), 4)).alias(f"rsi_{p}_{d}"))
    return out.select(*keep, *cols)


def williams_r(bars: DataFrame, windows=(5, 14), keep=KEEP) -> DataFrame:
    cols = []
    for w in windows:
        top, bottom = roll(F.max, F.col("high"), w), roll(F.min, F.col("low"), w)
        cols.append(rnd(div((top - F.col("close")) * -100, top - bottom), 4).alias(f"williams_{w}"))
    return bars.select(*keep, *cols)


def cci(bars: DataFrame, windows=(5, 14), keep=KEEP) -> DataFrame:
    """Commodity channel index on high + low + close: deviations are taken w times too large, in whole numbers, and so is their mean."""
    out = bars.withColumn("tp", F.col("high") + F.col("low") + F.col("close"))
    cols = []
    for w in windows:
        out = out.withColumn(f"l{w}", F.collect_list("tp").over(last(w)))
        total = F.aggregate(f"l{w}", F.lit(0).cast("long"), lambda a, x: a + x)
        out = out.withColumn(f"t{w}", total)
        off = F.aggregate(F.transform(f"l{w}", lambda x: F.abs(x * w - F.col(f"t{w}"))), F.lit(0).cast("long"), lambda a, x: a + x)
        value = div((F.col("tp") * w - F.col(f"t{w}")) * w, off) / F.lit(0.015)
        cols.append(F.when(F.size(f"l{w}") == w, rnd(value, 4)).alias(f"cci_{w}"))
    return out.select(*keep, *cols)


def bollinger(bars: DataFrame, w: int = 20, z: int = 42, keep=KEEP) -> DataFrame:
    """Bands over the close; the middle band times the deviation over the close, and its score, from ten thousandths."""
    close, mid, sd = F.col("close"), mean(F.col("close"), w), std_exact(F.col("close"), w)
    cols = [rnd(div(mid + sd * 2, close), 6).alias("bb_high"), rnd(div(mid - sd * 2, close), 6).alias("bb_low"), rnd(div(mid * sd, close), 4).alias("bb_mid_raw")]
    out = bars.select("*", steps(div(mid * sd, close), 4).alias("__mid"))
    return out.select(*keep, *cols, rnd(z_exact(F.col("__mid"), z), 6).alias("bb_mid"))


def fwd_return(bars: DataFrame, horizons=(1, 2, 5, 10), keep=KEEP) -> DataFrame:
    """Labels: percent to the close r rows on, and whether it is up; null where that row is not known yet."""
    cols = []
    for r in horizons:
        up = lead("close", r) - F.col("close")
        cols += [rnd(div(up * 100, F.col("close")), 4).alias(f"return_pct_{r}"), F.when(up.isNotNull(), flag(up > 0)).alias(f"return_{r}")]
    return bars.select(*keep, *cols)


def past_return(bars: DataFrame, horizons=(1, 5), look: int = 10, keep=KEEP) -> DataFrame:
    """Return since d rows ago: over today's close (label side), over the old close, and how many of the last `look` rows were up by the latter."""
    cols = []
    for d in horizons:
        up = F.col("close") - lag("close", d)
        cols += [rnd(div(up * 100, F.col("close")), 4).alias(f"past_ret_pct_{d}"), flag(up > 0).alias(f"past_ret_{d}"), rnd(div(up * 100, lag("close", d)), 4).alias(f"past_ret_old_pct_{d}")]
    out = bars.select(*keep, *cols)
    return out.select("*", *[F.sum(f"past_ret_{d}").over(last(look)).alias(f"sum{look}_past_ret_{d}") for d in horizons])
