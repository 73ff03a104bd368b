"""Moving averages, distances from extremes, runs above and below an average. Bars in, bars with columns out; one partitioning by symbol serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chunks import numbered
from ..functions.extremes import moving_extremes, moving_moments
from ..functions.rolling import KEEP, div, lag, last, mean, rnd, roll, series, steps, upto, z_exact
from ..functions.segments import DAYS, before

LONG, SHORT = (10, 25, 50, 100, 200), (5, 10, 15)


def sma_ratio(bars: DataFrame, windows=SHORT, keep=KEEP) -> DataFrame:
    """close / SMA_w, and the ratio of each two neighbouring averages."""
    close = F.col("close")
    out = [rnd(div(close, mean(close, w)), 6).alias(f"sma_{w}") for w in windows]
    out += [rnd(div(mean(close, a), mean(close, b)), 6).alias(f"sma_{a}_{b}") for a, b in zip(windows, windows[1:], strict=False)]
    return bars.select(*keep, *out)


def close_rel(bars: DataFrame, windows=SHORT, keep=KEEP) -> DataFrame:
    """close over the highest high and the lowest low; high and low over the same."""
    out = []
    for w in windows:
        top, bottom = roll(F.max, F.col("high"), w), roll(F.min, F.col("low"), w)
        out += [rnd(div(F.col("close"), top), 6).alias(f"close_rel_max_{w}"), rnd(div(F.col("close"), bottom), 6).alias(f"close_rel_min_{w}")]
        out += [rnd(div(F.col("high"), top), 6).alias(f"rel_max_{w}"), rnd(div(F.col("low"), bottom), 6).alias(f"rel_min_{w}")]
    return bars.select(*keep, *out)


def sma_lag(bars: DataFrame, windows=(10, 25), look=20, keep=KEEP) -> DataFrame:
    """SMA_w over its own lowest and highest value of the last `look` rows."""
    out = bars.select(*keep, *[mean(F.col("close"), w).alias(f"s{w}") for w in windows])
    cols = [x for w in windows for x in (rnd(div(F.col(f"s{w}"), roll(F.min, F.col(f"s{w}"), look)), 6).alias(f"sma_{w}_rel_min"), rnd(div(F.col(f"s{w}"), roll(F.max, F.col(f"s{w}"), look)), 6).alias(f"sma_{w}_rel_max"))]
    return out.select(*keep, *cols)


def rows_since(bars: DataFrame, windows=(10, 50), keep=KEEP) -> DataFrame:
    """Rows since the first highest high and the first lowest low of a window."""
    rn = F.row_number().over(series())
    out = bars.withColumn("rn", rn)
    cols = []
    for w in windows:
        top = F.max(F.struct("high", (-F.col("rn")).alias("at"))).over(last(w))
        bottom = F.min(F.struct("low", F.col("rn").alias("at"))).over(last(w))
        full = F.col("rn") >= w
        cols += [F.when(full, F.col("rn") + top["at"]).alias(f"since_max_{w}"), F.when(full, F.col("rn") - bottom["at"]).alias(f"since_min_{w}")]
    return out.select(*keep, *cols)


def extremes_long(bars: DataFrame, windows=(5, 252, 1000)) -> DataFrame:
    """close_rel's closes, rows_since and Williams' %R over windows of any length, for symbols of any length."""
    rows, close = numbered(bars.select("symbol", "date", "high", "low", "close")), F.col("close")
    for w in windows:
        high, low = F.struct(F.col("high").alias("v"), (-F.col("rn")).alias("at")), F.struct(F.col("low").alias("v"), F.col("rn").alias("at"))
        rows = moving_extremes(rows, w, {"top": high}, {"bottom": low})
        top, bottom, out = F.col("top.v"), F.col("bottom.v"), {}
        out |= {f"close_rel_max_{w}": rnd(div(close, top), 6), f"close_rel_min_{w}": rnd(div(close, bottom), 6), f"williams_{w}": rnd(div((top - close) * -100, top - bottom), 4)}
        out |= {f"since_max_{w}": F.col("rn") + F.col("top.at"), f"since_min_{w}": F.col("rn") - F.col("bottom.at")}
        rows = rows.withColumns(out).drop("top", "bottom")
    return rows.drop("rn", "high", "low", "close")


def moments_long(bars: DataFrame, windows=(5, 252, 1000), days: int = DAYS) -> DataFrame:
    """Scores and bands of the close and the deviation of its daily returns over windows of any length, for symbols of any length.

    Returns are whole numbers of 10^-9, so that all sums are exact. The first row has no return, and a close of 0 gives none to the next row;
    a window with such a row has no volatility. Infinite and unknown values are null.
    """
    close, old = F.col("close"), F.col("__old")
    rows = numbered(before(bars.select("symbol", "date", "close"), "close", "__old", days).withColumn("ret", steps(div(close - old, old), 9)).drop("__old"))
    for w in windows:
        rows = moving_moments(rows, w, {"c": close, "r": F.col("ret")})
        mid, sd = F.col("mean_c"), F.col("std_c")
        out = {f"zscore_{w}": rnd(div(close - mid, sd), 6), f"bb_high_{w}": rnd(div(mid + sd * 2, close), 6), f"bb_low_{w}": rnd(div(mid - sd * 2, close), 6)}
        out |= {f"volatility_{w}": rnd(F.col("std_r") / F.lit(1e9), 3)}
        rows = rows.withColumns(out).drop("mean_c", "std_c", "mean_r", "std_r")
    return rows.drop("rn", "ret", "close")


def open_gap(bars: DataFrame, keep=KEEP) -> DataFrame:
    return bars.select(*keep, rnd(div(F.col("open"), lag("close")), 6).alias("open_gap"))


def zscores(bars: DataFrame, windows=(5, 10, 25, 50), keep=KEEP) -> DataFrame:
    close = F.col("close")
    return bars.select(*keep, *[rnd(z_exact(close, w), 6).alias(f"zscore_{w}") for w in windows])


def norm_slope(bars: DataFrame, windows=(10, 25, 50), keep=KEEP) -> DataFrame:
    """Least-squares slope of close / first close over places 0..w-1, from exact sums."""
    rn, close = F.col("rn"), F.col("close")
    out, cols = bars.withColumn("rn", F.row_number().over(series()).cast("long")), []
    for w in windows:
        # sum((i - mean i) * y), i = 0..w-1; twelve times that over w (w^2 - 1) is the slope
        s, sxy = roll(F.sum, close, w), roll(F.sum, rn * close, w)
        top = F.lit(2) * (sxy - (rn - w + 1) * s) - F.lit(w - 1) * s
        slope = top.cast("double") * F.lit(6.0) / F.lit(float(w * (w * w - 1)))
        cols.append(rnd(div(slope, lag("close", w - 1)), 6).alias(f"slope_{w}"))
    return out.select(*keep, *cols)


def run_counter(rows: DataFrame, sign: Column, name: str) -> DataFrame:
    """Signed counter of rows on one side: it goes on while the sign stays; when it turns, the counter starts from 0 and not from 1.

    Closed form over the runs of equal signs. A run's start is 0 or 1: after a run of zeros or of two rows and more
    the counter is known, and in runs of one row it alternates. anchor: the last earlier run of either kind; d: runs since.
    """
    keys = [c for c in rows.columns if c != "__s"]
    first = F.row_number().over(series()) == 1
    out = rows.withColumn("__s", F.when(first, 0).otherwise(F.coalesce(sign, F.lit(0))))
    turn = F.coalesce(F.col("__s") != lag("__s"), F.lit(True)).cast("int")
    out = out.withColumn("__k", F.sum(turn).over(upto()))
    run = series("symbol", "__k")
    out = out.withColumn("__o", F.row_number().over(run) - 1).withColumn("__first", F.col("__o") == 0)
    out = out.withColumn("__next_turn", F.coalesce(lead_of("__k"), F.lit(-1)) != F.col("__k"))
    # at a run's last row its length is known: offset + 1
    anchor = F.when(F.col("__next_turn") & ((F.col("__s") == 0) | (F.col("__o") >= 1)), F.struct(F.col("__k").alias("k"), (F.col("__s") == 0).alias("zero")))
    before = series().rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("__a", F.last(anchor, ignorenulls=True).over(before))
    head = F.first("__a").over(run.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("__h", head)
    d = F.col("__k") - F.col("__h.k")
    start = F.when(F.col("__h").isNull(), 0).when(F.col("__h.zero"), d % 2).otherwise((d - 1) % 2)
    return out.select(*keys, (F.col("__s") * (start + F.col("__o"))).cast("long").alias(name))


def lead_of(c: str) -> Column:
    return F.lead(c).over(series())


def num_days(bars: DataFrame, w: int = 10, keep=KEEP) -> DataFrame:
    """Rows above (positive) or below the w-row average."""
    out = bars.select(*keep, (F.col("close") * w).alias("c"), roll(F.sum, F.col("close"), w).alias("m"))
    sign = F.when(F.col("c") > F.col("m"), 1).when(F.col("c") < F.col("m"), -1).otherwise(0)
    return run_counter(out, sign, f"num_days_{w}").select(*keep, f"num_days_{w}")
