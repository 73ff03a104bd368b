"""Queries on the stored history of the grid's predictions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import lead, rounded, series
from ..operators import metrics, select, volatility
from ..operators.metrics import KEYS
from ..sources.shared import written
from ..sources.tables import bars_daily
from . import loop
from .daily import S, rnd
from .loop import HORIZONS, PRED

CUTOFFS = ("1994-01-01", "1996-01-01", "1998-01-01")
EDGE, MOST, LEAST = 0.01, 6, 2
#: Days that the filter of streak_buckets_newest keeps.
NEWEST = 730


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir)
    cols = [F.struct(F.lit(r).alias("horizon"), F.when(lead("close", r) > F.col("close"), 1).when(lead("close", r) <= F.col("close"), 0).alias("label")) for r in HORIZONS]
    return bars.select("symbol", "date", "close", F.row_number().over(series()).cast("long").alias("rn"), F.array(*cols).alias("l")).select("symbol", "date", "close", "rn", F.inline("l"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop.history(spark, sf_dir).select("symbol", "date", *KEYS, "run", "pred", "pred_class", "test_pos_n", "acc")


def scored(history: DataFrame) -> DataFrame:
    return metrics.with_composite(metrics.config_metrics(history))


def config_metrics(spark, sf_dir):
    return scored(predictions(spark, sf_dir))


def top_by_horizon(spark, sf_dir):
    return select.top(scored(predictions(spark, sf_dir)), 5, "horizon", "composite", "log_loss").select(*KEYS, "composite", "log_loss", "rank")


def calibration(spark, sf_dir):
    return metrics.calibration(predictions(spark, sf_dir))


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir).select(F.concat_ws("|", "symbol", "horizon").alias("symbol"), "date", "label")
    found = volatility.label_streak(rows)
    return found.select(F.split("symbol", r"\|")[0].alias("symbol"), F.split("symbol", r"\|")[1].cast("int").alias("horizon"), "date", "streak", "streak_before")


def streak_buckets(spark, sf_dir):
    return metrics.streak_buckets(predictions(spark, sf_dir), streaks(spark, sf_dir))


def newest(rows: DataFrame) -> DataFrame:
    """A caller's filter: the last NEWEST days of a horizon's history."""
    return rows.join(rows.agg(F.date_sub(F.max("date"), NEWEST).alias("after")), F.col("date") > F.col("after")).drop("after")


def streak_buckets_newest(spark, sf_dir):
    """Scores by streak of what a filter of the caller keeps of each horizon."""
    return metrics.streak_buckets(metrics.filtered(predictions(spark, sf_dir), HORIZONS, newest), streaks(spark, sf_dir))


def top_by_wba(spark, sf_dir):
    """The ten best configurations of each horizon by their scores by streak, saved and read back, in hundredths."""
    return rounded(written(select.top(streak_buckets(spark, sf_dir), 10, "horizon", "wba_close", "wba_open").select(*KEYS, "wba_close", "wba_open", "rank"), "top-by-wba"))


def best_per_set(spark, sf_dir):
    return select.best_per_set(scored(predictions(spark, sf_dir)), 3).select(*KEYS, "composite", "rank")


def edge_select(spark, sf_dir):
    return select.edge_select(scored(predictions(spark, sf_dir)), EDGE, MOST, LEAST).select(*KEYS, "pos_edge", "neg_edge", "composite", "rank")


def semi_selected(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return select.of_selected(rows, select.best_per_set(scored(rows), 3)).select("symbol", "date", *KEYS, "pred")


def pending_days(spark, sf_dir):
    return select.pending_days(predictions(spark, sf_dir).where(F.col("date") < F.lit("1997-06-01").cast("date")), labels(spark, sf_dir))


def ensemble(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    m = scored(rows)
    return select.ensemble(select.of_selected(rows, select.best_per_set(m, 3)), m)


def ensemble_precision(spark, sf_dir):
    """Of all configurations together."""
    rows = predictions(spark, sf_dir)
    return select.ensemble_precision(select.ensemble(rows, metrics.config_metrics(rows)), labels(spark, sf_dir).select("symbol", "date", "horizon", "label"))


def price_ratio(spark, sf_dir):
    return select.price_ratio(predictions(spark, sf_dir), bars_daily(spark, sf_dir))


def cutoff_metrics(spark, sf_dir):
    return metrics.cutoff_metrics(predictions(spark, sf_dir), list(CUTOFFS)).select("cutoff", *KEYS, "records", "pos_rate", "brier", "mcc")


def history_dedup(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    again = rows.withColumn("run", F.col("run") + 1).withColumn("pred", F.rint(F.col("pred") * 10) / 10)
    return select.deduplicated(rows.unionByName(again)).select("symbol", "date", *KEYS, "run", "pred")


def history_append(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(*KEYS, "run", "pred_class")
    return select.merged(rows.where("horizon = 2"), rows, 5)


QUERIES = {f.__name__: f for f in (top_by_wba, config_metrics, top_by_horizon, calibration, streak_buckets, streak_buckets_newest, best_per_set, edge_select, semi_selected, pending_days, ensemble, ensemble_precision, price_ratio, cutoff_metrics, history_dedup, history_append)}

K = ", ".join(KEYS)
def _metrics(source: str, keys: str) -> str:
    d = lambda a, b: f"({a})::DOUBLE / nullif({b}, 0)"
    return f"""(SELECT {keys}, records, {rnd('ups::DOUBLE / records', 6)} AS pos_rate, {rnd(f'({d("tp", "pp")} + {d("tn", "np")}) / 2', 2)} AS bal_prec, {rnd(f'({d("stp", "spp")} + {d("stn", "snp")}) / 2', 2)} AS bal_prec_th,
  {rnd('b', 6)} AS brier, CASE WHEN ups > 0 AND ups < records THEN {rnd('ll', 6)} END AS log_loss,
  CASE WHEN ups > 0 AND ups < records AND pp > 0 AND np > 0 THEN {rnd('(tp::DOUBLE * tn - (pp - tp)::DOUBLE * (np - tn)) / nullif(sqrt(pp::DOUBLE * (tp + np - tn)::DOUBLE * (tn + pp - tp)::DOUBLE * np::DOUBLE), 0)', 6)} END AS mcc,
  {rnd(d('tp', 'pp'), 6)} AS pprec, {rnd(d('tn', 'np'), 6)} AS nprec, {rnd('sure::DOUBLE / records', 6)} AS cov_th, {rnd(d('stp', 'spp'), 6)} AS pprec_th, {rnd(d('stn', 'snp'), 6)} AS nprec_th, pp AS pos_preds, np AS neg_preds
FROM (SELECT {keys}, count(*) AS records, count_if(y = 1) AS ups, count_if(h = 1) AS pp, count_if(h = 0) AS np, count_if(h = 1 AND y = 1) AS tp, count_if(h = 0 AND y = 0) AS tn, count_if(s) AS sure, count_if(s AND h = 1) AS spp, count_if(s AND h = 0) AS snp,
    count_if(s AND h = 1 AND y = 1) AS stp, count_if(s AND h = 0 AND y = 0) AS stn, avg((p - y) * (p - y)) AS b, avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS ll
  FROM (SELECT *, CASE WHEN p >= 0.55 THEN 1 WHEN p <= 4.4999999999999996e-1 THEN 0 END AS h, p >= 0.75 OR p <= 0.25 AS s FROM (SELECT *, test_pos_n AS y, greatest(1e-15, least(1 - 1e-15, pred)) AS p FROM {source} WHERE test_pos_n IS NOT NULL AND (pred > 0.55 OR pred < 4.4999999999999996e-1)))
  WHERE h IS NOT NULL GROUP BY {keys}))"""


METRICS = PRED + f""",
m0 AS {_metrics('pred', K)},
m AS (SELECT *, {rnd('bal_prec * 0.5 + mcc * 0.25 + (1.0 - brier) * 0.125 + bal_prec_th * cov_th * 0.1', 6)} AS composite FROM m0)"""
BEST = METRICS + f""",
best AS (
  SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY composite DESC NULLS LAST, {K})::INT AS rank FROM m
  QUALIFY row_number() OVER (PARTITION BY horizon, features ORDER BY composite DESC NULLS LAST, {K}) = 1),
best3 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY horizon ORDER BY composite DESC NULLS LAST, {K})::INT AS rank FROM best QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY composite DESC NULLS LAST, {K}) <= 3)"""
ENS = BEST + f""",
chosen AS (SELECT pred.*, m.pos_rate, m.pprec, m.nprec FROM pred JOIN m USING ({K}) WHERE ({K}) IN (SELECT ({K}) FROM best3)),
ens AS (
  SELECT symbol, horizon, date, sum(round_even(CASE WHEN CASE WHEN pred < 0.45 THEN pred - 1 ELSE pred END > 0 THEN pprec - pos_rate ELSE -nprec + (1.0 - pos_rate) END * 100, 0))::BIGINT AS e FROM chosen GROUP BY symbol, horizon, date),
ensemble AS (SELECT symbol, horizon, date, e / 100.0::DOUBLE AS ensemble_edge, {rnd('e / 100.0::DOUBLE + 0.5', 2)} AS ensemble_pred, row_number() OVER (PARTITION BY symbol, horizon ORDER BY date)::INT AS days_to_exp FROM ens)"""
ENS_ALL = ENS.replace(f" WHERE ({K}) IN (SELECT ({K}) FROM best3)", "")
SIDE = {b: f"{abs(b)}{'n' if b < 0 else 'p'}" for b in (1, -1, 2, -2, 3, -3, 4, -4)}
_pair = lambda b, s: f"(a_{SIDE[b]}_{s} + a_{SIDE[-b]}_{s}) / 2"
_score = lambda s: rnd(f"({_pair(1, s)} * 2.0 + {_pair(2, s)} * 1.5 + {_pair(3, s)} * 1.25 + {_pair(4, s)}) / 5.75", 4)
ORACLE = {
    "config_metrics": METRICS + "\nSELECT * FROM m",
    "top_by_horizon": METRICS + f"\nSELECT {K}, composite, log_loss, row_number() OVER w::INT AS rank FROM m QUALIFY row_number() OVER w <= 5 WINDOW w AS (PARTITION BY horizon ORDER BY composite DESC NULLS LAST, log_loss DESC NULLS LAST, {K})".replace("row_number() OVER w::INT AS rank", f"(row_number() OVER (PARTITION BY horizon ORDER BY composite DESC NULLS LAST, log_loss DESC NULLS LAST, {K}))::INT AS rank").replace("QUALIFY row_number() OVER w <= 5 WINDOW w AS (", "QUALIFY row_number() OVER (").rstrip(")") + ") <= 5",
    "calibration": PRED + f""",
e AS (SELECT horizon, features, quantile_cont(pred, {[i / 10 for i in range(11)]}) AS edges FROM pred WHERE test_pos_n IS NOT NULL GROUP BY ALL),
b AS (SELECT pred.horizon, pred.features, pred, test_pos_n, greatest(1, len(list_filter(list_distinct(edges), lambda x: x < pred)))::INT AS bin FROM pred JOIN e ON pred.horizon = e.horizon AND pred.features = e.features WHERE test_pos_n IS NOT NULL)
SELECT horizon, features, bin, count(*) AS n, {rnd('avg(pred)', 6)} AS p_mean, {rnd('avg(test_pos_n)', 6)} AS y_rate, min(pred) AS p_min, max(pred) AS p_max FROM b GROUP BY horizon, features, bin""",
    "streak_buckets": PRED + f""",
i AS (SELECT symbol, date, horizon, label, row_number() OVER (PARTITION BY symbol, horizon ORDER BY date) - row_number() OVER (PARTITION BY symbol, horizon, label ORDER BY date) AS isle FROM l WHERE label IS NOT NULL),
st AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon, label, isle ORDER BY date) * CASE label WHEN 1 THEN 1 ELSE -1 END AS streak FROM i),
sb AS (SELECT symbol, date, horizon, streak, coalesce(lag(streak) OVER (PARTITION BY symbol, horizon ORDER BY date), 0) AS before FROM st),
j AS (SELECT pred.*, greatest(-4, least(4, streak)) AS c, greatest(-4, least(4, before)) AS o FROM pred JOIN sb ON pred.symbol = sb.symbol AND pred.date = sb.date AND pred.horizon = sb.horizon WHERE pred >= 0.55 OR pred <= 4.4999999999999996e-1),
a AS (SELECT {K}, {', '.join(f'count_if({s} = {b}) AS n_{n}_{s}, avg(CASE WHEN {s} = {b} THEN acc END) AS a_{n}_{s}' for s in 'co' for b, n in SIDE.items())} FROM j GROUP BY {K})
SELECT {K}, {', '.join(f'n_{n}_{s}, {rnd(f"a_{n}_{s}", 6)} AS acc_{n}_{s}' for s in 'co' for n in SIDE.values())}, {_score('c')} AS wba_close, {_score('o')} AS wba_open FROM a""",
    "best_per_set": BEST + f"\nSELECT {K}, composite, rank FROM best3",
    "edge_select": METRICS + f""",
x AS (SELECT *, {rnd('pprec - pos_rate', 2)} AS pos_edge, {rnd('nprec - (1.0 - pos_rate)', 2)} AS neg_edge FROM m),
q AS (SELECT *, count_if(coalesce(pos_edge > {EDGE} AND neg_edge > {EDGE}, false)) OVER (PARTITION BY horizon) AS qualified FROM x),
a AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY composite DESC NULLS LAST, {K})::INT AS rank FROM q WHERE pos_edge > {EDGE} AND neg_edge > {EDGE} AND qualified >= {LEAST}),
f AS (SELECT * FROM q WHERE qualified < {LEAST} QUALIFY row_number() OVER (PARTITION BY horizon, features ORDER BY composite DESC NULLS LAST, {K}) = 1),
fb AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY composite DESC NULLS LAST, {K})::INT AS rank FROM f)
SELECT {K}, pos_edge, neg_edge, composite, rank FROM a WHERE rank <= {MOST} UNION ALL SELECT {K}, pos_edge, neg_edge, composite, rank FROM fb WHERE rank <= {LEAST}""",
    "semi_selected": BEST + f"\nSELECT symbol, date, {K}, pred FROM pred WHERE ({K}) IN (SELECT ({K}) FROM best3)",
    "pending_days": PRED + f""",
a AS (SELECT {K}, max(date) AS last_date FROM pred WHERE date < DATE '1997-06-01' GROUP BY {K}),
d AS (SELECT DISTINCT horizon AS h, date FROM l WHERE label IS NOT NULL)
SELECT {K}, last_date, count(*) AS pending FROM a JOIN d ON h = horizon AND date > last_date GROUP BY {K}, last_date HAVING count(*) > 2""",
    "ensemble": ENS + "\nSELECT * FROM ensemble",
    "ensemble_precision": ENS_ALL + f"""
SELECT horizon, {rnd('avg(CASE WHEN ensemble_pred > 0.52 THEN (label = 1)::INT END)', 3)} AS pos_prec, {rnd('avg(CASE WHEN ensemble_pred < 0.48 THEN (label = 0)::INT END)', 3)} AS neg_prec, count(*) AS n
FROM ensemble JOIN (SELECT symbol, date, horizon, label FROM l WHERE label IS NOT NULL) USING (symbol, date, horizon) WHERE ensemble_pred > 0.52 OR ensemble_pred < 0.48 GROUP BY horizon""",
    "price_ratio": PRED + f""",
d AS (SELECT DISTINCT symbol, horizon, date FROM pred), c AS (SELECT symbol, arg_max(close, date) AS last_close FROM bars GROUP BY symbol)
SELECT d.symbol, d.horizon, d.date, b.close AS predicted_price, c.last_close, {rnd('c.last_close::DOUBLE / nullif(b.close, 0) - 1', 6)} AS ratio FROM d JOIN bars b ON d.symbol = b.symbol AND d.date = b.date JOIN c ON c.symbol = d.symbol""",
    "cutoff_metrics": PRED + f""",
cp AS (SELECT pred.*, x::DATE AS cutoff FROM pred JOIN (SELECT unnest({list(CUTOFFS)}) AS x) ON date >= x::DATE)
SELECT cutoff, {K}, records, pos_rate, brier, mcc FROM {_metrics('cp', 'cutoff, ' + K)}""",
    "history_dedup": PRED + f"""
SELECT symbol, date, {K}, run, pred FROM (SELECT symbol, date, {K}, run, pred FROM pred UNION ALL SELECT symbol, date, {K}, run + 1, round_even(pred * 10, 0) / 10 FROM pred)
QUALIFY row_number() OVER (PARTITION BY symbol, date, {K} ORDER BY run DESC, pred) = 1""",
    "history_append": PRED + f"\nSELECT DISTINCT {K}, run, pred_class FROM pred WHERE horizon = 2 UNION ALL SELECT DISTINCT {K}, run, pred_class FROM pred WHERE horizon = 5",
}
ORACLE["top_by_wba"] = f"""
WITH t AS ({ORACLE["streak_buckets"]}), k AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY wba_close DESC NULLS LAST, wba_open DESC NULLS LAST, {K})::INT AS rank FROM t)
SELECT {K}, {rnd('wba_close', 2)} AS wba_close, {rnd('wba_open', 2)} AS wba_open, rank FROM k WHERE rank <= 10"""

ORACLE["streak_buckets_newest"] = ORACLE["streak_buckets"].replace("FROM pred JOIN sb", f"FROM (SELECT * FROM pred QUALIFY date > max(date) OVER (PARTITION BY horizon) - {NEWEST}) pred JOIN sb")
ORACLE["full_grid_metrics"] = METRICS.replace(PRED, loop.FULL) + "\nSELECT * FROM m"
