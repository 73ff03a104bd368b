"""Queries on daily bars, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rolling
from ..operators import momentum, trend, volatility, volume
from ..sources.tables import bars_daily, context_daily

BARS = """
sold AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_orderpriority AS symbol, o_orderdate::DATE AS date, round(o_totalprice * 100)::BIGINT AS cents, q FROM orders LEFT JOIN sold ON o_orderkey = l_orderkey),
bars AS (
  SELECT symbol, date, arg_min(cents, o_orderkey) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, o_orderkey) AS close, coalesce(sum(q), 0)::BIGINT AS volume
  FROM o GROUP BY symbol, date)"""


def over(w: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


S = "(PARTITION BY symbol ORDER BY date)"
UPTO = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, w: int) -> str:
    return f"(CASE WHEN count({x}) OVER {over(w)} = {w} THEN {f}({x}) OVER {over(w)} END)"


def mean(x: str, w: int) -> str:
    return f"({roll('sum', x, w)}::DOUBLE / {w}.0)"


def std(x: str, w: int) -> str:
    return f"sqrt(({w} * {roll('sum', f'({x})::HUGEINT * ({x})', w)} - {roll('sum', x, w)}::HUGEINT * {roll('sum', x, w)})::DOUBLE / {w * (w - 1)}.0)"


def rnd(x: str, n: int) -> str:
    return f"(round_even(({x}) * 1e{n}, 0) / 1e{n})"


def whole(x: str, n: int) -> str:
    return f"round_even(({x}) * 1e{n}, 0)::BIGINT"


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {S}"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER {S}"


def sql(cols: dict[str, str], *steps: str, source: str = "bars", keys: str = "symbol, date") -> str:
    listed = ",\n  ".join(f"{v} AS {k}" for k, v in cols.items())
    return "WITH " + ",\n".join([BARS.strip(), *steps]) + f"\nSELECT {keys}, {listed}\nFROM {source}"


def z(x: str, w: int) -> str:
    return div(f"{x} - {mean(x, w)}", std(x, w))


PREV = f"p AS (SELECT *, {lag('close')} AS prev FROM bars)"
UP, DOWN = "(CASE WHEN close > prev THEN volume ELSE 0 END)", "(CASE WHEN close < prev THEN volume ELSE 0 END)"
FLOW = "coalesce((2 * close - low - high)::DOUBLE / nullif((high - low)::DOUBLE, 0) * volume, 0.0)"

ORACLE = {
    "sma_ratio": sql({**{f"sma_{w}": rnd(div("close", mean("close", w)), 6) for w in (5, 10, 15)}, **{f"sma_{a}_{b}": rnd(div(mean("close", a), mean("close", b)), 6) for a, b in ((5, 10), (10, 15))}}),
    "close_rel": sql({k: v for w in (5, 10, 15) for k, v in {
        f"close_rel_max_{w}": rnd(div("close", roll("max", "high", w)), 6), f"close_rel_min_{w}": rnd(div("close", roll("min", "low", w)), 6),
        f"rel_max_{w}": rnd(div("high", roll("max", "high", w)), 6), f"rel_min_{w}": rnd(div("low", roll("min", "low", w)), 6)}.items()}),
    "sma_lag": sql({k: v for w in (10, 25) for k, v in {f"sma_{w}_rel_min": rnd(div(f"s{w}", roll("min", f"s{w}", 20)), 6), f"sma_{w}_rel_max": rnd(div(f"s{w}", roll("max", f"s{w}", 20)), 6)}.items()},
                   f"s AS (SELECT symbol, date, {mean('close', 10)} AS s10, {mean('close', 25)} AS s25 FROM bars)", source="s"),
    "rows_since": sql({k: v for w in (10, 50) for k, v in {
        f"since_max_{w}": f"CASE WHEN rn >= {w} THEN rn + (max({{'high': high, 'at': -rn}}) OVER {over(w)}).at END",
        f"since_min_{w}": f"CASE WHEN rn >= {w} THEN rn - (min({{'low': low, 'at': rn}}) OVER {over(w)}).at END"}.items()},
        f"r AS (SELECT *, (row_number() OVER {S})::INT AS rn FROM bars)", source="r"),
    "open_gap": sql({"open_gap": rnd(div("open", lag("close")), 6)}),
    "zscore": sql({f"zscore_{w}": rnd(z("close", w), 6) for w in (5, 10, 25, 50)}),
    "norm_slope": sql({f"slope_{w}": rnd(div(f"(2 * ({roll('sum', 'rn * close', w)} - (rn - {w} + 1) * {roll('sum', 'close', w)}) - {w - 1} * {roll('sum', 'close', w)})::DOUBLE * 6.0 / {w * (w * w - 1)}.0", lag("close", w - 1)), 6) for w in (10, 25, 50)},
                      f"r AS (SELECT *, row_number() OVER {S} AS rn FROM bars)", source="r"),
    "rsi": sql({f"rsi_{p}_{d}": f"CASE WHEN count(*) OVER {over(p)} = {p} THEN " + rnd(div(f"100 * sum(greatest(coalesce(d{d}, 0), 0)) OVER {over(p)}", f"sum(abs(coalesce(d{d}, 0))) OVER {over(p)}"), 4) + " END" for p in (14, 21) for d in (1, 3, 5)},
               "d AS (SELECT symbol, date, " + ", ".join(f"close - {lag('close', d)} AS d{d}" for d in (1, 3, 5)) + " FROM bars)", source="d"),
    "williams_r": sql({f"williams_{w}": rnd(div(f"({roll('max', 'high', w)} - close) * -100", f"{roll('max', 'high', w)} - {roll('min', 'low', w)}"), 4) for w in (5, 14)}),
    "cci": sql({f"cci_{w}": f"CASE WHEN len(l{w}) = {w} THEN " + rnd(div(f"(tp * {w} - list_sum(l{w})) * {w}", f"list_sum(list_transform(l{w}, lambda x: abs(x * {w} - list_sum(l{w}))))") + " / 0.015::DOUBLE", 4) + " END" for w in (5, 14)},
               "t AS (SELECT symbol, date, high + low + close AS tp FROM bars)", f"l AS (SELECT *, list(tp) OVER {over(5)} AS l5, list(tp) OVER {over(14)} AS l14 FROM t)", source="l"),
    "bollinger": sql({"bb_high": "hi", "bb_low": "lo", "bb_mid_raw": "raw", "bb_mid": rnd(z("m", 42), 6)},
        f"""r AS (SELECT *, {rnd(div(f"{mean('close', 20)} + {std('close', 20)} * 2", "close"), 6)} AS hi, {rnd(div(f"{mean('close', 20)} - {std('close', 20)} * 2", "close"), 6)} AS lo,
  {rnd(div(f"{mean('close', 20)} * {std('close', 20)}", "close"), 4)} AS raw, {whole(div(f"{mean('close', 20)} * {std('close', 20)}", "close"), 4)} AS m FROM bars)""", source="r"),
    "fwd_return": sql({k: v for r in (1, 2, 5, 10) for k, v in {f"return_pct_{r}": rnd(div(f"({lead('close', r)} - close) * 100", "close"), 4), f"return_{r}": f"CASE WHEN {lead('close', r)} > close THEN 1 WHEN {lead('close', r)} <= close THEN 0 END"}.items()}),
    "past_return": sql({k: v for d in (1, 5) for k, v in {f"past_ret_pct_{d}": f"p{d}", f"past_ret_{d}": f"f{d}", f"past_ret_old_pct_{d}": f"o{d}", f"sum10_past_ret_{d}": f"(sum(f{d}) OVER {over(10)})::BIGINT"}.items()},
        "f AS (SELECT symbol, date, " + ", ".join(f"{rnd(div(f'(close - {lag("close", d)}) * 100', 'close'), 4)} AS p{d}, CASE WHEN close > {lag('close', d)} THEN 1 ELSE 0 END AS f{d}, {rnd(div(f'(close - {lag("close", d)}) * 100', lag('close', d)), 4)} AS o{d}" for d in (1, 5)) + " FROM bars)", source="f"),
    "obv": sql({**{k: v for w in (5, 10) for k, v in {f"obv_roc_{w}": rnd(div(f"v - {lag('v', w)}", lag("v", w)), 6), f"obv_z_{w}": rnd(z("v", w), 6)}.items()}, "obv": rnd(z("v", 42), 6)}, PREV, f"v AS (SELECT symbol, date, (sum({UP} - {DOWN}) OVER {UPTO})::BIGINT AS v FROM p)", source="v"),
    "vol_ratio": sql({k: v for w in (10, 25, 50, 100) for k, v in {f"vol_ratio_{w}": f"r{w} / 1e6::DOUBLE", f"vol_ratio_{w}_z": rnd(z(f"r{w}", 42), 6)}.items()}, PREV, f"v AS (SELECT symbol, date, {UP} AS up, {DOWN} AS down FROM p)",
        "r AS (SELECT symbol, date, " + ", ".join(f"coalesce({whole(div(roll('sum', 'up', w), roll('sum', 'down', w)), 6)}, 0) AS r{w}" for w in (10, 25, 50, 100)) + " FROM v)", source="r"),
    "cmf": sql({f"cmf_{w}": rnd(div(roll("sum", "flow", w), roll("sum", "volume", w)), 6) for w in (10, 20)}, f"f AS (SELECT *, {FLOW} AS flow FROM bars)", source="f"),
    "adl": sql({"adl": "a::DOUBLE / 1000.0", "adl_z": rnd(z("a", 42), 6)}, f"a AS (SELECT symbol, date, (sum(round_even({FLOW} * 1000, 0)::BIGINT) OVER {UPTO})::BIGINT AS a FROM bars)", source="a"),
    "vroc": sql({f"vroc_{w}": rnd(div(f"volume - {lag('volume', w)}", lag("volume", w)), 6) for w in (3, 5, 10)}),
    "vol_spike": sql({f"vol_spike_{w}": rnd(div("volume", f"CASE WHEN count(*) OVER {over(w)} = {w} THEN quantile_cont(volume::DOUBLE, 0.5) OVER {over(w)} END"), 6) for w in (10, 20)}),
    "atr": sql({k: v for w in (7, 14, 21) for k, v in {f"atr_{w}": rnd(f"s{w}::DOUBLE / {w}.0", 4), f"atr_z_{w}": rnd(z(f"s{w}", 42), 6)}.items()},
               f"t AS (SELECT symbol, date, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars)",
               "s AS (SELECT symbol, date, " + ", ".join(f"{roll('sum', 'tr', w)}::BIGINT AS s{w}" for w in (7, 14, 21)) + " FROM t)", source="s"),
    "volatility": sql({k: v for w in (5, 10, 25) for k, v in {f"volatility_{w}": f"coalesce(v{w} / 1000.0::DOUBLE, 0)", f"volatility_{w}_z": f"coalesce({rnd(z(f'v{w}', 42), 6)}, 0)", f"price_vol_ratio_{w}_z": f"coalesce({rnd(z(f'p{w}', 42), 6)}, 0)"}.items()},
        f"r AS (SELECT symbol, date, close, {div(f'close - {lag("close")}', lag('close'))} AS ret FROM bars)", "v AS (SELECT symbol, date, close, " + ", ".join(f"{whole(roll('stddev_samp', 'ret', w), 3)} AS v{w}" for w in (5, 10, 25)) + " FROM r)",
        "q AS (SELECT *, " + ", ".join(f"{whole(div('close', f'v{w} / 1000.0::DOUBLE'), 0)} AS p{w}" for w in (5, 10, 25)) + " FROM v)", source="q"),
    "num_days": "WITH RECURSIVE " + BARS.strip() + f""",
m AS (SELECT symbol, date, row_number() OVER {S} AS rn, close * 10 AS c, {roll('sum', 'close', 10)} AS m FROM bars),
n AS (
  SELECT symbol, date, rn, 0::BIGINT AS v FROM m WHERE rn = 1
  UNION ALL
  SELECT m.symbol, m.date, m.rn, CASE WHEN m.c > m.m THEN CASE WHEN n.v < 0 THEN 0 ELSE n.v + 1 END WHEN m.c < m.m THEN CASE WHEN n.v > 0 THEN 0 ELSE n.v - 1 END ELSE 0 END
  FROM n JOIN m ON m.symbol = n.symbol AND m.rn = n.rn + 1)
SELECT symbol, date, v AS num_days_10 FROM n""",
    "label_streak": sql({"label": "label", "streak": "streak", "streak_before": f"coalesce({lag('streak')}, 0)"},
        f"l AS (SELECT * FROM (SELECT symbol, date, CASE WHEN {lead('close', 5)} > close THEN 1 WHEN {lead('close', 5)} <= close THEN 0 END AS label FROM bars) WHERE label IS NOT NULL)",
        f"i AS (SELECT *, row_number() OVER {S} - row_number() OVER (PARTITION BY symbol, label ORDER BY date) AS isle FROM l)",
        "t AS (SELECT symbol, date, label, (row_number() OVER (PARTITION BY symbol, label, isle ORDER BY date) * CASE label WHEN 1 THEN 1 ELSE -1 END)::INT AS streak FROM i)", source="t"),
    "context_ffill": sql({n: f"last_value({n} IGNORE NULLS) OVER {UPTO}" for s in ("vx", "sk") for n in (f"{s}_change_1", f"{s}_change_5", f"{s}_change_10", f"{s}_cross", f"{s}_std")},
        "c AS (SELECT 'context' AS symbol, l_shipdate::DATE AS date, max(CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice * 100)::BIGINT END) AS vx, min(CASE WHEN l_returnflag = 'N' THEN round(l_extendedprice * 100)::BIGINT END) AS sk FROM lineitem WHERE day(l_shipdate) % 7 <> 0 GROUP BY 2)",
        "x AS (SELECT date, " + ", ".join(", ".join(f"{rnd(div(f'{n} - {lag(n, d)}', lag(n, d)), 6)} AS {n}_change_{d}" for d in (1, 5, 10)) + f", CASE WHEN {mean(n, 3)} > {mean(n, 20)} THEN 1 ELSE -1 END AS {n}_cross, {rnd(std(n, 5), 1)} AS {n}_std" for n in ("vx", "sk")) + " FROM c)",
        "j AS (SELECT symbol, bars.date, x.* EXCLUDE (date) FROM bars LEFT JOIN x ON bars.date = x.date)", source="j"),
    "flagship": "WITH " + BARS.strip() + f""",
f AS (SELECT symbol, close * 10 > {roll('sum', 'close', 10)} AS above, CASE WHEN {lead('close', 5)} > close THEN 1 WHEN {lead('close', 5)} <= close THEN 0 END AS up FROM bars)
SELECT symbol, count(*) AS days, count_if(above) AS above, {rnd('avg(CASE WHEN above THEN up END)', 6)} AS hit_above, {rnd('avg(CASE WHEN NOT above THEN up END)', 6)} AS hit_below
FROM f WHERE above IS NOT NULL AND up IS NOT NULL GROUP BY symbol""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By symbol: how often the close is above its 10-row average, and how often the close five rows on is higher, above and below it."""
    bars = bars_daily(spark, sf_dir)
    up = rolling.lead("close", 5) - F.col("close")
    rows = bars.select("symbol", (F.col("close") * 10 > rolling.roll(F.sum, F.col("close"), 10)).alias("above"), F.when(up > 0, 1).when(up <= 0, 0).alias("up")).na.drop()
    hit = lambda c: rolling.rnd(F.avg(F.when(c, F.col("up"))), 6)
    return rows.groupBy("symbol").agg(F.count("*").alias("days"), F.count_if("above").alias("above"), hit(F.col("above")).alias("hit_above"), hit(~F.col("above")).alias("hit_below"))


def context_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.with_context(bars_daily(spark, sf_dir), volatility.context_features(context_daily(spark, sf_dir)))


def label_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = momentum.fwd_return(bars_daily(spark, sf_dir), (5,))
    return volatility.label_streak(labels.select("symbol", "date", F.col("return_5").alias("label")))


def label_streak_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = momentum.fwd_return(bars_daily(spark, sf_dir), (5,))
    return volatility.label_streak_long(labels.select("symbol", "date", F.col("return_5").alias("label")))


def on_bars(f):
    return lambda spark, sf_dir: f(bars_daily(spark, sf_dir))


QUERIES = {
    **{f.__name__: on_bars(f) for f in (trend.sma_ratio, trend.close_rel, trend.sma_lag, trend.rows_since, trend.open_gap, trend.norm_slope, trend.num_days, momentum.rsi, momentum.williams_r, momentum.cci, momentum.bollinger, momentum.fwd_return, momentum.past_return, volume.obv, volume.vol_ratio, volume.cmf, volume.adl, volume.vroc, volume.vol_spike, volatility.atr, volatility.volatility)},
    "zscore": on_bars(trend.zscores),
    "context_ffill": context_ffill,
    "label_streak": label_streak,
    "label_streak_long": label_streak_long,
    "obv_long": on_bars(volume.obv_long),
    "adl_long": on_bars(volume.adl_long),
    "extremes_long": on_bars(trend.extremes_long),
    "moments_long": on_bars(trend.moments_long),
    "flagship": flagship,
}
ORACLE |= {f"{name}_long": ORACLE[name] for name in ("obv", "adl", "label_streak")}


def extremes_sql(w: int) -> str:
    over = f"CASE WHEN rn >= {w - 1} THEN {{}} OVER (PARTITION BY symbol ORDER BY rn ROWS {w - 1} PRECEDING) END"
    top, bottom = over.format("max(high)"), over.format("min(low)")
    first = over.format("max({'v': high, 'at': -rn})"), over.format("min({'v': low, 'at': rn})")
    out = {f"close_rel_max_{w}": div("close", top), f"close_rel_min_{w}": div("close", bottom), f"williams_{w}": div(f"(({top}) - close) * -100", f"({top}) - ({bottom})")}
    cols = [f"{rnd(x, 4 if c.startswith('w') else 6)} AS {c}" for c, x in out.items()]
    return ", ".join([*cols, f"rn + ({first[0]}).at AS since_max_{w}", f"rn - ({first[1]}).at AS since_min_{w}"])


ORACLE["extremes_long"] = "WITH " + BARS.strip() + f""",
x AS (SELECT *, row_number() OVER {S} - 1 AS rn FROM bars)
SELECT symbol, date, {', '.join(map(extremes_sql, (5, 252, 1000)))} FROM x"""


def moments_sql(w: int) -> str:
    mid, sd = mean("close", w), std("close", w)
    out = {f"zscore_{w}": rnd(div(f"close - {mid}", sd), 6), f"bb_high_{w}": rnd(div(f"{mid} + {sd} * 2", "close"), 6), f"bb_low_{w}": rnd(div(f"{mid} - {sd} * 2", "close"), 6)}
    out |= {f"volatility_{w}": rnd(f"{std('ret', w)} / 1e9::DOUBLE", 3)}
    return ", ".join(f"{x} AS {c}" for c, x in out.items())


ORACLE["moments_long"] = "WITH " + BARS.strip() + f""",
x AS (SELECT symbol, date, close, {whole(div(f"close - {lag('close')}", lag('close')), 9)} AS ret FROM bars)
SELECT symbol, date, {', '.join(map(moments_sql, (5, 252, 1000)))} FROM x"""
