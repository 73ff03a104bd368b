"""Queries on exponential means (with SQL twins) and on fitted models, which SQL cannot express and tests check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import div as safe_div
from ..functions.rolling import lag, lead, without_inf
from ..operators import fit, folds, momentum, prune, scan, trend, volatility, volume
from ..sources.tables import bars_daily, context_daily
from .daily import BARS, S, div, over, rnd
from .daily import ORACLE as DAILY

FEATURES = ["ret1", "gap", "span", "vol"]
FOLDS = folds.Folds(train=folds.DAYS_A_YEAR, test=5, step=5, purge=5)


def macd(spark, sf_dir):
    return scan.macd(bars_daily(spark, sf_dir))


def adx(spark, sf_dir):
    return scan.adx(bars_daily(spark, sf_dir))


def macd_long(spark, sf_dir):
    return scan.macd_long(bars_daily(spark, sf_dir))


def adx_long(spark, sf_dir):
    return scan.adx_long(bars_daily(spark, sf_dir))


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with label, four features (unknown where a price before is zero) and a missing value's infinity as 0, in slices of folds."""
    bars = bars_daily(spark, sf_dir)
    label = F.when(lead("close", 5) > F.col("close"), 1).when(lead("close", 5) <= F.col("close"), 0)
    features = {"ret1": safe_div(F.col("close"), lag("close")), "gap": safe_div(F.col("open"), lag("close")), "span": safe_div(F.col("high"), F.col("low")), "vol": F.col("volume").cast("double")}
    rows = bars.select("symbol", "date", label.alias("label"), *[x.alias(n) for n, x in features.items()])
    return folds.with_slices(folds.numbered(without_inf(rows, FEATURES)), FOLDS)


def walk_forward_fit(spark, sf_dir):
    return fit.walk_forward(sliced(spark, sf_dir), FEATURES, FOLDS)


def perm_importance(spark, sf_dir):
    return fit.importance(sliced(spark, sf_dir), FEATURES, FOLDS)


def importance_rollup(spark, sf_dir):
    return fit.rollup(perm_importance(spark, sf_dir), "symbol")


def importance_chosen(spark, sf_dir):
    return fit.chosen_features(perm_importance(spark, sf_dir))


#: Operators of the panel in order; of equal names the first one stays.
PANEL = (
    trend.sma_ratio, trend.close_rel, trend.sma_lag, trend.rows_since, trend.open_gap, trend.zscores, trend.norm_slope, trend.num_days, momentum.rsi, momentum.williams_r, momentum.cci, momentum.bollinger,
    volume.obv, volume.vol_ratio, volume.cmf, volume.adl, volume.vroc, volume.vol_spike, volatility.atr, volatility.volatility, scan.macd, scan.adx, momentum.past_return, momentum.fwd_return,
)
#: Sets of the panel's columns by the beginnings of their names, as a catalog.
SETS = {
    "ma": ("sma_", "close_rel_", "rel_", "since_", "open_gap", "num_days"), "rsi": ("rsi_",), "macd": ("macd",), "volume": ("obv", "vol_ratio_", "cmf_", "adl", "vroc_", "vol_spike_"), "atr_adx": ("atr_", "plus_di", "minus_di", "adx"),
    "volatility": ("volatility_", "price_vol_"), "slope": ("slope_", "zscore_", "williams_", "cci_", "bb_"), "past_return": ("past_ret_", "sum10_"),
}


def panel_of(bars: DataFrame, own: list[str]) -> DataFrame:
    """The columns of all operators after those of the bars, without the `own` ones."""
    out = bars
    for operator in PANEL:
        more = operator(out, keep=tuple(out.columns))
        out = more.select(*dict.fromkeys(more.columns))
    return out.drop(*own)


def feature_panel(spark, sf_dir):
    """All features and labels of a day in one row: each operator hands on what it is given, and all windows are by symbol in order of date, so the bars move once and nothing is joined."""
    bars = bars_daily(spark, sf_dir)
    return panel_of(bars, bars.columns[2:])


def context_panel(spark, sf_dir):
    """The panel with the context indices of the day, or the last known ones. The context, a row a day, meets the bars before they are windowed."""
    bars = bars_daily(spark, sf_dir)
    context = volatility.context_features(context_daily(spark, sf_dir))
    return panel_of(volatility.with_context(bars, context, keep=bars.columns), bars.columns[2:])


def catalog_of(spark: SparkSession, columns: list[str]) -> DataFrame:
    """set_name, col_name, pos: the columns of each set, in order, by the pattern of their names."""
    rows = [(name, c, i) for name, starts in SETS.items() for i, c in enumerate(c for c in columns if c.startswith(starts))]
    return spark.createDataFrame(rows, "set_name string, col_name string, pos int")


def set_coverage(spark, sf_dir):
    """By feature set and column: how many days of the panel have a value."""
    panel = feature_panel(spark, sf_dir)
    names = [c for c in panel.columns if c not in ("symbol", "date")]
    counts = panel.agg(F.array(*[F.struct(F.lit(c).alias("col_name"), F.count(c).alias("days")) for c in names]).alias("x")).select(F.inline("x"))
    return prune.resolved(catalog_of(spark, names)).join(counts, "col_name").select("set_name", "col_name", "days")


QUERIES = {f.__name__: f for f in (macd, adx, macd_long, adx_long, walk_forward_fit, perm_importance, importance_rollup, importance_chosen, feature_panel, context_panel, set_coverage)}

NUM = f"b AS (SELECT *, row_number() OVER {S} AS rn FROM bars)"


def ema(name: str, source: str, x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return f"{name} AS (SELECT symbol, rn, {x}::DOUBLE AS y FROM {source} WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {1 - a!r}::DOUBLE * e.y + {a!r}::DOUBLE * s.{x} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"


D = 1 - 1 / 14
ORACLE = {
    "macd": "WITH RECURSIVE " + BARS.strip() + ",\n" + ",\n".join([NUM, ema("e12", "b", "close", 12), ema("e26", "b", "close", 26),
        f"m AS (SELECT symbol, b.date, rn, close, {rnd('e12.y - e26.y', 3)} AS macd FROM b JOIN e12 USING (symbol, rn) JOIN e26 USING (symbol, rn))", ema("g", "m", "macd", 9)])
        + f"\nSELECT symbol, date, {rnd(div('macd', 'close'), 4)} AS macd, {rnd(div('g.y', 'close'), 4)} AS macd_signal FROM m JOIN g USING (symbol, rn)",
    "adx": "WITH RECURSIVE " + BARS.strip() + ",\n" + NUM + f""",
t AS (SELECT symbol, date, rn, greatest(high - low, abs(high - lag(close) OVER {S}), abs(low - lag(close) OVER {S})) AS tr, greatest(high - lag(high) OVER {S}, 0)::DOUBLE AS up, abs(least(low - lag(low) OVER {S}, 0))::DOUBLE AS down FROM b),
e AS (
  SELECT symbol, rn, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d, 0.0::DOUBLE AS n FROM t WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn, {D!r}::DOUBLE * e.u + t.up, {D!r}::DOUBLE * e.d + t.down, {D!r}::DOUBLE * e.n + 1 FROM e JOIN t ON t.symbol = e.symbol AND t.rn = e.rn + 1),
a AS (SELECT symbol, date, rn, CASE WHEN count(*) OVER {over(14)} = 14 THEN (sum(tr) OVER {over(14)})::DOUBLE / 14.0 END AS atr FROM t),
p AS (SELECT symbol, date, {div('CASE WHEN rn > 1 THEN u / n END', 'atr')} * 100 AS plus, {div('CASE WHEN rn > 1 THEN d / n END', 'atr')} * 100 AS minus FROM a JOIN e USING (symbol, rn)),
x AS (SELECT *, {div('abs(plus - minus)', 'plus + minus')} * 100 AS dx FROM p)
SELECT symbol, date, {rnd('plus', 3)} AS plus_di, {rnd('minus', 3)} AS minus_di, CASE WHEN count(dx) OVER {over(14)} = 14 THEN {rnd(f'avg(dx) OVER {over(14)}', 3)} END AS adx FROM x""",
}
PARTS = [ORACLE.get(f.__name__) or DAILY["zscore" if f is trend.zscores else f.__name__] for f in PANEL]
ORACLE["feature_panel"] = "SELECT * FROM " + " JOIN ".join(f"({part}) t{i}" + (" USING (symbol, date)" if i else "") for i, part in enumerate(PARTS))
ORACLE["context_panel"] = f"SELECT * FROM ({ORACLE['feature_panel']}) p JOIN ({DAILY['context_ffill']}) c USING (symbol, date)"
ORACLE |= {f"{name}_long": ORACLE[name] for name in ("macd", "adx")}
ORACLE["set_coverage"] = f"""
WITH panel AS ({ORACLE["feature_panel"]}),
n AS (UNPIVOT (SELECT count(COLUMNS(* EXCLUDE (symbol, date))) FROM panel) ON COLUMNS(*) INTO NAME col_name VALUE days),
s AS (SELECT * FROM (VALUES {', '.join(f"('{name}', '{start}')" for name, starts in SETS.items() for start in starts)}) v(set_name, start))
SELECT set_name, col_name, days FROM n JOIN s ON starts_with(col_name, start)"""
