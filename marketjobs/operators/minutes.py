"""Session features of minute bars: labels of the time of day, shares and magnitudes by session, ranges of the first and last minutes.

All features of a day come from one grouping by symbol and date over conditional aggregates; minutes are never sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import div, last, rnd

OPEN = 570
#: (label, first minute of the day, first minute after); None: the session's end. Fixed values, the first that fits counts.
DETAIL = (
    ("overnight", 0, 420), ("early_pre_market", 420, 540), ("late_pre_market", 540, 570), ("early_open", 570, 585), ("late_open", 585, 600),
    ("morning", 600, 720), ("midday", 720, 840), ("late_day", 840, 930), ("early_close", 930, 945), ("late_close", 945, None),
    ("early_post_market", None, 975), ("late_post_market", 975, 1020), ("post_market_other", 1020, 1201),
)
SESSIONS = tuple(x[0] for x in DETAIL)


def with_session(calendar: DataFrame) -> DataFrame:
    """calendar (date, close_et: time of the close in New York) with session_duration in minutes since the open, and is_early_close: before 16:00."""
    minute = F.hour("close_et") * 60 + F.minute("close_et")
    return calendar.withColumn("session_duration", minute - OPEN).withColumn("is_early_close", minute < 960)


def labelled(minutes: DataFrame, calendar_of) -> DataFrame:
    """minutes (ts in UTC) with date and minute of New York, session_duration, labels, and distances to open and close.

    calendar_of: DataFrame with date -> (date, close_et), a row a day.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    out = minutes.withColumn("local", local).withColumn("date", F.to_date("local")).withColumn("tod", F.hour("local") * 60 + F.minute("local")).drop("local")
    out = out.join(with_session(calendar_of(out)).select("date", "session_duration"), "date", "left")
    tod, end = F.col("tod"), F.col("session_duration") + OPEN
    coarse = F.when(tod < 420, "overnight").when(tod < OPEN, "pre_market").when(tod <= end, "open_market").otherwise("post_market")
    fine = F
    for name, a, b in DETAIL:
        cond = (tod <= end) & (tod >= a) if b is None else (tod > end) & (tod < b) if a is None else (tod >= a) & (tod < b)
        fine = fine.when(cond, name)
    return out.withColumn("session", coarse).withColumn("detail", fine.otherwise("other")).withColumn("to_open", tod - OPEN).withColumn("to_close", end - tod)


def with_ratios(minutes: DataFrame) -> DataFrame:
    """Full sessions only; magnitude (in ten thousandths) and direction of close/open, high/low, high/close and low/close."""
    out = minutes.na.drop().where(F.col("session_duration") == 390)
    for name, a, b in (("oc", "close", "open"), ("hl", "high", "low"), ("hc", "high", "close"), ("lc", "low", "close")):
        x, y = F.col(a), F.col(b)
        out = out.withColumn(f"{name}_mag", F.rint((div(x, y) - 1) * 10000).cast("long"))
        for level, pct in (("low", 0.001), ("high", 0.01)):
            out = out.withColumn(f"{name}_dir_{level}", (x > y * (1 + pct)).cast("int") - (x < y * (1 - pct)).cast("int"))
    return out


def in_session(name: str, column: str = "detail") -> Column:
    return F.col(column) == name


def percent(name: str, column: str = "detail") -> list[Column]:
    """Shares of rising and falling minutes of those that move, and of flat ones of all; -1 where there are none."""
    n = lambda c: F.count_if(in_session(name, column) & c)
    up, down, flat = n(F.col("oc_mag") > 0), n(F.col("oc_mag") < 0), n(F.col("oc_mag") == 0)
    share = lambda a, b: F.coalesce(rnd(div(a, b), 3), F.lit(-1.0))
    return [share(up, up + down).alias(f"{name}_up"), share(down, up + down).alias(f"{name}_down"), share(flat, up + down + flat).alias(f"{name}_flat")]


def magnitude(name: str) -> list[Column]:
    """Mean and largest rise, mean and largest fall; 0 where there is none."""
    x = lambda c: F.when(in_session(name) & c, F.col("oc_mag"))
    pos, neg = x(F.col("oc_mag") > 0), x(F.col("oc_mag") < 0)
    out = lambda v, n: F.coalesce(rnd(div(v, F.lit(10000)), 6), F.lit(0.0)).alias(f"{name}_{n}")
    return [out(F.try_divide(F.sum(pos), F.count(pos)), "pos_avg"), out(F.max(pos), "pos_max"), out(F.try_divide(F.sum(neg), F.count(neg)), "neg_avg"), out(F.min(neg), "neg_min")]


def ranges(interval: int) -> list[Column]:
    """Highest over lowest close of the first and the last minutes."""
    cols = []
    for side, name in (("to_open", "first"), ("to_close", "last")):
        x = F.when((F.col(side) >= 0) & (F.col(side) < interval), F.col("close"))
        cols.append(rnd(div(F.max(x), F.min(x)), 6).alias(f"{name}_{interval}m"))
    return cols


def by_day(minutes: DataFrame, *columns: list[Column]) -> DataFrame:
    return minutes.groupBy("symbol", "date").agg(*reduce(lambda a, b: a + b, columns))


def rolled(days: DataFrame, rows: int = 3, keep=("symbol", "date")) -> DataFrame:
    """Means over the last three days (fewer at the start) of the features that are known before the close."""
    names = [c for c in days.columns if c not in ("symbol", "date") and not any(x in c for x in ("close_", "post_", "overnight_"))]
    return days.select(*keep, *[rnd(F.avg(c).over(last(rows)), 4).alias(f"{c}_roll{rows}") for c in names])
