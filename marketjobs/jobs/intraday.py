"""Queries on minute bars, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import minutes as m
from ..operators import momentum, trend
from ..sources.tables import bars_minute, bars_of_days, calendar
from .daily import S, div, lead, mean, rnd

INTERVALS = (5, 15, 60)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.labelled(bars_minute(spark, sf_dir), calendar)


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.with_ratios(labelled(spark, sf_dir))


def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("symbol", "ts", "date", "to_open", "to_close", "session", "detail")


def session_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ratios(spark, sf_dir)
    return out.select("symbol", "ts", *[c for c in out.columns if "_mag" in c or "_dir_" in c])


def session_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.by_day(ratios(spark, sf_dir), *[m.percent(s) for s in m.SESSIONS])


def session_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.by_day(ratios(spark, sf_dir), *[m.magnitude(s) for s in m.SESSIONS])


def first_last_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.by_day(ratios(spark, sf_dir), *[m.ranges(i) for i in INTERVALS])
    return out.where("first_5m is not null")


def session_roll3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rolled(session_pct(spark, sf_dir))


def session_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each session, and whether it closes early, from the time of its close."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    return m.with_session(calendar(bars_minute(spark, sf_dir).select(F.to_date(local).alias("date"))))


def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, magnitudes and ranges of each day with a first interval, with their means over three days: one grouping, and no join."""
    days = m.by_day(ratios(spark, sf_dir), *[f(s) for s in m.SESSIONS for f in (m.percent, m.magnitude)], *[m.ranges(i) for i in INTERVALS]).where("first_5m is not null")
    return m.rolled(days, keep=days.columns)


def minute_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All session features of the minutes with daily features and labels of the same symbols and days."""
    daily = bars_of_days(labelled(spark, sf_dir))
    features = momentum.fwd_return(trend.sma_ratio(daily, (3, 5), keep=("symbol", "date", "close")), (1, 2), keep=("symbol", "date", "sma_3", "sma_5", "sma_3_5"))
    return session_features(spark, sf_dir).join(features, ["symbol", "date"])


QUERIES = {f.__name__: f for f in (session_calendar, session_features, minute_panel, session_labels, session_ratios, session_pct, session_magnitude, first_last_range, session_roll3)}

FINE = "CASE " + " ".join(f"WHEN {f'tod <= 570 + session_duration AND tod >= {a}' if b is None else f'tod > 570 + session_duration AND tod < {b}' if a is None else f'tod >= {a} AND tod < {b}'} THEN '{n}'" for n, a, b in m.DETAIL) + " ELSE 'other' END"
BASE = f"""WITH e AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS minute, {{'ts': ts, 'id': event_id}} AS stamp, round(value * 100)::BIGINT AS cents FROM events),
b AS (SELECT symbol, minute AS ts, arg_min(cents, stamp) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, stamp) AS close, count(*) AS volume FROM e GROUP BY symbol, minute),
n AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS local FROM b),
t AS (SELECT *, local::DATE AS date, (hour(local) * 60 + minute(local))::INT AS tod FROM n),
cal AS (SELECT DISTINCT date, CASE WHEN day(date) % 13 = 0 THEN 210 ELSE 390 END AS session_duration FROM t WHERE isodow(date) <= 5),
l AS (
  SELECT symbol, ts, t.date, open, high, low, close, volume, tod, session_duration, tod - 570 AS to_open, 570 + session_duration - tod AS to_close,
    CASE WHEN tod < 420 THEN 'overnight' WHEN tod < 570 THEN 'pre_market' WHEN tod <= 570 + session_duration THEN 'open_market' ELSE 'post_market' END AS session, {FINE} AS detail
  FROM t LEFT JOIN cal ON t.date = cal.date)"""
PAIRS = (("oc", "close", "open"), ("hl", "high", "low"), ("hc", "high", "close"), ("lc", "low", "close"))
RATIOS = BASE + ",\nr AS (SELECT *, " + ", ".join(
    f"round_even(({a}::DOUBLE / nullif({b}, 0) - 1) * 10000, 0)::BIGINT AS {n}_mag, " + ", ".join(f"({a} > {b} * {1 + p}::DOUBLE)::INT - ({a} < {b} * {1 - p}::DOUBLE)::INT AS {n}_dir_{lv}" for lv, p in (("low", 0.001), ("high", 0.01)))
    for n, a, b in PAIRS
) + " FROM l WHERE session_duration = 390)"


def share(a: str, b: str) -> str:
    return f"coalesce({rnd(div(a, b), 3)}, -1)"


def _pct(s: str) -> str:
    up, down, flat = (f"count_if(detail = '{s}' AND oc_mag {c} 0)" for c in (">", "<", "="))
    return f"{share(up, f'{up} + {down}')} AS {s}_up, {share(down, f'{up} + {down}')} AS {s}_down, {share(flat, f'{up} + {down} + {flat}')} AS {s}_flat"


def _mag(s: str) -> str:
    x = lambda c: f"CASE WHEN detail = '{s}' AND oc_mag {c} 0 THEN oc_mag END"
    out = lambda v: f"coalesce({rnd(f'({v})::DOUBLE / 10000', 6)}, 0)"
    return f"{out(f'sum({x(">")})::DOUBLE / nullif(count({x(">")}), 0)')} AS {s}_pos_avg, {out(f'max({x(">")})')} AS {s}_pos_max, {out(f'sum({x("<")})::DOUBLE / nullif(count({x("<")}), 0)')} AS {s}_neg_avg, {out(f'min({x("<")})')} AS {s}_neg_min"


def _range(i: int) -> str:
    x = lambda c: f"CASE WHEN {c} >= 0 AND {c} < {i} THEN close END"
    return ", ".join(f"{rnd(div(f'max({x(c)})', f'min({x(c)})'), 6)} AS {n}_{i}m" for c, n in (("to_open", "first"), ("to_close", "last")))


PCT = "SELECT symbol, date, " + ",\n".join(_pct(s) for s in m.SESSIONS) + " FROM r GROUP BY symbol, date"
KNOWN = [f"{s}_{k}" for s in m.SESSIONS for k in ("up", "down", "flat") if not any(x in f"{s}_{k}" for x in ("close_", "post_", "overnight_"))]
ORACLE = {
    "session_labels": BASE + "\nSELECT symbol, ts, date, to_open, to_close, session, detail FROM l",
    "session_ratios": RATIOS + "\nSELECT symbol, ts, " + ", ".join(f"{n}_mag, {n}_dir_low, {n}_dir_high" for n, _, _ in PAIRS) + " FROM r",
    "session_pct": RATIOS + "\n" + PCT,
    "session_magnitude": RATIOS + "\nSELECT symbol, date, " + ",\n".join(_mag(s) for s in m.SESSIONS) + " FROM r GROUP BY symbol, date",
    "first_last_range": RATIOS + "\nSELECT * FROM (SELECT symbol, date, " + ", ".join(_range(i) for i in INTERVALS) + " FROM r GROUP BY symbol, date) WHERE first_5m IS NOT NULL",
    "session_roll3": RATIOS + f", d AS ({PCT})\nSELECT symbol, date, " + ", ".join(f"{rnd(f'avg({c}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 4)} AS {c}_roll3" for c in KNOWN) + " FROM d",
}
NAMES = [f"{s}_{k}" for s in m.SESSIONS for k in ("up", "down", "flat", "pos_avg", "pos_max", "neg_avg", "neg_min")] + [f"{n}_{i}m" for i in INTERVALS for n in ("first", "last")]
ROLLED = [c for c in NAMES if not any(x in c for x in ("close_", "post_", "overnight_"))]
FEATURES = RATIOS + ",\nd AS (SELECT symbol, date, " + ",\n".join([f(s) for s in m.SESSIONS for f in (_pct, _mag)] + [_range(i) for i in INTERVALS]) + """ FROM r GROUP BY symbol, date),
s AS (SELECT *, """ + ", ".join(f"{rnd(f'avg({c}) OVER w', 4)} AS {c}_roll3" for c in ROLLED) + """ FROM d WHERE first_5m IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
ORACLE["session_calendar"] = BASE + "\nSELECT date, date + to_hours(CASE WHEN session_duration = 210 THEN 13 ELSE 16 END) AS close_et, session_duration, session_duration < 390 AS is_early_close FROM cal"
ORACLE["session_features"] = FEATURES + "\nSELECT * FROM s"
ORACLE["minute_panel"] = FEATURES + f""",
y AS (SELECT symbol, date, arg_max(close, ts) AS close FROM l GROUP BY symbol, date),
f AS (
  SELECT symbol, date, {", ".join(f"{rnd(div('close', mean('close', w)), 6)} AS sma_{w}" for w in (3, 5))}, {rnd(div(mean('close', 3), mean('close', 5)), 6)} AS sma_3_5,
    {", ".join(f"{rnd(div(f'({lead("close", r)} - close) * 100', 'close'), 4)} AS return_pct_{r}, CASE WHEN {lead('close', r)} > close THEN 1 WHEN {lead('close', r)} <= close THEN 0 END AS return_{r}" for r in (1, 2))}
  FROM y)
SELECT * FROM s JOIN f USING (symbol, date)"""
