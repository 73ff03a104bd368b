"""The loop of a deployed job: grid, folds, importance, selection, fit, tagged predictions in a stored history, pending and unlabelled days; and the same in SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks
from ..functions.rolling import lag, lead, rnd
from ..operators import fit, metrics, walk
from ..operators.metrics import KEYS
from ..sources import history as stored
from ..sources.shared import new_path, once, path_of, written
from ..sources.tables import bars_daily
from .daily import BARS, S
from .daily import rnd as sql_rnd

HORIZONS, TEST = (2, 5), 5
SETS = {"trend": ("change", "gap"), "activity": ("body", "turnover")}
CONFIGS = [walk.Config(y, f, 1.0, h, m) for y, f, h, m in product((1, 2), ("trend", "trend-activity"), ("together", "separately"), (1, 2))]
#: All modes, for one set with a new part.
MODE_CONFIGS = [walk.Config(1, "trend-activity", 1.0, h, 1) for h in walk.MODES]
#: The whole product of all axes, with modes where there is a new part.
FULL_CONFIGS = [
    walk.Config(y, f, p, h, k, m) for y, f, p, h, k, m in product((1, 2), ("trend", "trend-activity"), (0.5, 1.0), walk.MODES, (1, 2), walk.MODELS) if "-" in f or h == "together"
]
#: History known so far, for the scoring of pending days.
KNOWN_UNTIL = "1997-06-01"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, close, rn, n, features, and label_r for each horizon; written once for all queries on the same tables."""
    return once(spark, path_of(spark, "panel", *tables(sf_dir)), lambda: panel_rows(spark, sf_dir))


def tables(sf_dir: str) -> list[str]:
    """What bars are made of."""
    return [f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet"]


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir)
    rows = chunks.numbered(bars).withColumn("rn", (F.col("rn") + 1).cast("int"))
    rows = rows.withColumn("n", F.count("*").over(chunks.whole("symbol")).cast("int"))
    prev = lambda c: F.col(c) - lag(c)
    cols = [walk.bucket(prev("close")).alias("change"), walk.bucket(F.col("open") - lag("close")).alias("gap"), walk.bucket(F.col("close") - F.col("open")).alias("body"), walk.bucket(prev("volume")).alias("turnover")]
    labels = [F.when(lead("close", r) > F.col("close"), 1).when(lead("close", r) <= F.col("close"), 0).alias(f"label_{r}") for r in HORIZONS]
    return rows.select("symbol", "date", "close", "rn", "n", *cols, *labels)


def of_horizon(rows: DataFrame, r: int) -> DataFrame:
    return rows.select("symbol", "date", "rn", "n", F.col(f"label_{r}").alias("label"), *walk.names_of(SETS))


def each_horizon(rows: DataFrame, f) -> DataFrame:
    out = [f(of_horizon(rows, r), r) for r in HORIZONS]
    return out[0].unionByName(out[1])


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_horizon(panel(spark, sf_dir), lambda rows, r: walk.run_grid(rows, r, TEST, CONFIGS, SETS))


def full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of the whole product of horizons, models, train years, sets, sizes of importance, modes and least features."""
    return each_horizon(panel(spark, sf_dir), lambda rows, r: walk.grid_joined(rows, r, TEST, FULL_CONFIGS, SETS))


def full_grid_metrics(spark, sf_dir):
    """Metrics and composite score of all configurations of the whole product."""
    return metrics.with_composite(metrics.config_metrics(full_grid(spark, sf_dir)))


def full_grid_models(spark, sf_dir):
    """By horizon, model and size of importance: predictions, folds and share of right ones, over all configurations."""
    rows = full_grid(spark, sf_dir).groupBy("horizon", "model", "pi_size")
    return rows.agg(F.count("*").alias("n"), F.sum("acc").alias("hits"), F.sum("n_features").alias("features_used"), F.max("run").alias("oldest_run"), F.sum(F.rint(F.col("pred") * 100).cast("long")).alias("pred_sum"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of the grid, from the stored history. The first query on a set of tables makes and appends them; the others only read."""
    path = path_of(spark, "history", *tables(sf_dir))
    if "grid" not in stored.runs(spark, path):
        stored.append(grid_rows(spark, sf_dir), path, "grid")
    return stored.load(spark, path)


def run_grid(spark, sf_dir):
    return history(spark, sf_dir)


def selection_modes(spark, sf_dir):
    return each_horizon(panel(spark, sf_dir), lambda rows, r: walk.chosen_features(rows, r, TEST, MODE_CONFIGS, SETS))


def score_unlabelled(spark, sf_dir):
    """Predictions of the newest days, whose outcome is not known."""
    return each_horizon(panel(spark, sf_dir), lambda rows, r: walk.run_grid(rows, r, TEST, CONFIGS, SETS, last_only=True)).drop("test_pos_n", "acc")


def known_history(spark: SparkSession, sf_dir: str) -> str:
    """The path of a new history that ends at KNOWN_UNTIL."""
    path = new_path(spark, "history")
    stored.append(history(spark, sf_dir).where(F.col("date") < F.lit(KNOWN_UNTIL).cast("date")), path, "known")
    return path


def pending(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Predictions of the labelled days of a panel since each configuration's last as-of date in the history at a path."""
    return each_horizon(rows, lambda own, r: walk.score_pending(own, stored.load(spark, path, horizon=r), r, CONFIGS, SETS))


def score_pending(spark, sf_dir):
    return pending(spark, panel(spark, sf_dir), known_history(spark, sf_dir))


def pending_history(spark, sf_dir):
    """The history with the pending days' predictions appended; a call on it as it is then finds none."""
    path, rows = known_history(spark, sf_dir), panel(spark, sf_dir)
    stored.append(pending(spark, rows, path), path, "pending")
    return stored.load(spark, path)


def runs_to_replay(spark, sf_dir):
    """By symbol and horizon: the earliest as-of date of the history, and how many folds its labelled days since make."""
    past = history(spark, sf_dir).groupBy("symbol", "horizon").agg(F.min("date").alias("first_date"))
    days = each_horizon(panel(spark, sf_dir), lambda rows, r: rows.where("label is not null").select("symbol", "date", F.lit(r).alias("horizon")))
    out = days.join(past, ["symbol", "horizon"]).where("date >= first_date").groupBy("symbol", "horizon", "first_date").agg(F.count("*").alias("days"))
    return out.withColumn("runs", F.floor(F.col("days") / TEST))


def fold_accuracy(spark, sf_dir):
    """Share of rightly called test days by fold and configuration."""
    return history(spark, sf_dir).groupBy("symbol", *KEYS, "run").agg(F.count("acc").alias("days"), rnd(F.avg("acc"), 6).alias("accuracy"))


def distinct_sets(spark, sf_dir):
    return history(spark, sf_dir).select("horizon", "features").distinct()


def importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_horizon(panel(spark, sf_dir), lambda rows, r: walk.importance_rows(rows, r, TEST, MODE_CONFIGS[0], SETS))


def grid_importance(spark, sf_dir):
    return importance_table(spark, sf_dir)


def grid_importance_rollup(spark, sf_dir):
    out = fit.rollup(written(importance_table(spark, sf_dir), "importance"), "symbol", "horizon")
    return out.withColumns({c: rnd(F.col(c), 6) for c in ("pi_sum", "pi_avg")})


def grid_importance_chosen(spark, sf_dir):
    return fit.chosen_features(written(importance_table(spark, sf_dir), "importance"), keys=("symbol", "horizon", "run"))


QUERIES = {f.__name__: f for f in (fold_accuracy, distinct_sets, grid_importance, grid_importance_rollup, grid_importance_chosen, full_grid_metrics, full_grid_models, run_grid, selection_modes, score_unlabelled, score_pending, pending_history, runs_to_replay)}

NAMES = walk.names_of(SETS)
GROUP = {f: g for g, own in SETS.items() for f in own}
CHANGE = {"change": f"close - lag(close) OVER {S}", "gap": f"open - lag(close) OVER {S}", "body": "close - open", "turnover": f"volume - lag(volume) OVER {S}"}
K = ", ".join(KEYS)


def lagged(c: str, w: str) -> str:
    return f"{c} - coalesce(lag({c}, {w}) OVER w, 0)"


def values(configs: list[walk.Config]) -> str:
    return ", ".join(f"('{c.model}', {c.train_years}, '{c.features}', {c.pi_size}::DOUBLE, '{c.pi_handling}', {c.min_feats})" for c in configs)


def base_sql(configs: list[walk.Config]) -> str:
    """CTEs wx (buckets), l (labels by horizon), wf (long rows by feature), wc (running counts), wt (counts of the last rows)."""
    years = sorted({c.train_years for c in configs})
    cells = [f"{c}{k}" for c in "nu" for k in range(3)]
    sizes = sorted({c.pi_rows for c in configs})
    by_size = lambda c: "CASE pd " + " ".join(f"WHEN {w} THEN {lagged(c, str(w))}" for w in sizes) + " END"
    by_year = lambda c: "CASE y " + " ".join(f"WHEN {y} THEN {lagged(c, str(245 * y))}" for y in years) + " END"
    return f"""
wx AS (
  SELECT symbol, date, open, close, row_number() OVER {S} AS rn, count(*) OVER (PARTITION BY symbol) AS n, lead(close, 2) OVER {S} AS c2, lead(close, 5) OVER {S} AS c5,
    {', '.join(f'coalesce(sign({v}) + 1, 1)::INT AS {f}' for f, v in CHANGE.items())}
  FROM bars),
l AS (
  SELECT wx.*, r AS horizon, CASE r WHEN 2 THEN CASE WHEN c2 > close THEN 1 WHEN c2 <= close THEN 0 END ELSE CASE WHEN c5 > close THEN 1 WHEN c5 <= close THEN 0 END END AS label
  FROM wx, (VALUES (2), (5)) h(r)),
wf AS ({' UNION ALL '.join(f"SELECT symbol, horizon, date, rn, n, label, '{f}' AS f, '{GROUP[f]}' AS grp, {f} AS b FROM l" for f in NAMES)}),
wc AS (
  SELECT *, {', '.join(f'count_if(b = {k}) OVER w AS n{k}, coalesce(sum(CASE WHEN b = {k} THEN label END) OVER w, 0) AS u{k}' for k in range(3))}
  FROM wf WINDOW w AS (PARTITION BY symbol, horizon, f ORDER BY rn)),
wt AS (
  SELECT symbol, horizon, date, rn, n, f, grp, y, pd, {', '.join(f'{by_year(c)} AS {c}' for c in cells)}, {', '.join(f'{by_size(c)} AS p{c}' for c in cells)},
    CASE y {' '.join(f'WHEN {y} THEN lag(date, {245 * y - 1}) OVER w' for y in years)} END AS train_start
  FROM wc, (VALUES {', '.join(f'({y})' for y in years)}) v(y), (VALUES {', '.join(f'({w})' for w in sizes)}) u(pd) WINDOW w AS (PARTITION BY symbol, horizon, f, y, pd ORDER BY rn))"""


def fit_sql(configs: list[walk.Config], fits: str, tag: str = "") -> str:
    """CTEs up to rate: the rates of all chosen features, by window ranks over long rows. fits: the rows of wt that a model is made at."""
    best = ", ".join(f"round_even((u{k} + 1) * 1e6::DOUBLE / (n{k} + 2), 0)::BIGINT AS r{k}" for k in range(3))
    part = f"PARTITION BY symbol, horizon, rn, {K}, part"
    return f"""
wg{tag} AS (
  SELECT *, greatest(pu0, pn0 - pu0) + greatest(pu1, pn1 - pu1) + greatest(pu2, pn2 - pu2) - greatest(pu0 + pu1 + pu2, pd - (pu0 + pu1 + pu2)) AS gain, {best}
  FROM wt WHERE rn >= 245 * y AND ({fits})),
wk{tag}(model, train_years, features, pi_size, pi_handling, min_feats) AS (VALUES {values(configs)}),
we{tag} AS (
  SELECT g.*, k.*, CASE WHEN pi_handling = 'together' OR NOT contains(features, '-') THEN 'all' WHEN pi_handling = 'separately' THEN grp WHEN grp = 'activity' THEN 'new' ELSE 'old' END AS part
  FROM wg{tag} g JOIN wk{tag} k ON y = train_years AND pd = least(245 * y, floor(242 * pi_size)) WHERE contains(features, grp)),
wr{tag} AS (
  SELECT *, gain * 100 > 3 * pd AS good, count_if(gain * 100 > 3 * pd) OVER ({part}) AS goods, row_number() OVER ({part} ORDER BY gain DESC, f) AS place
  FROM we{tag}),
rate{tag} AS (
  SELECT * FROM wr{tag}
  WHERE CASE WHEN part = 'new' AND pi_handling = 'exclude_new' THEN true WHEN part = 'new' THEN gain * 100 > pd AND place <= 4 WHEN goods >= min_feats THEN good ELSE place <= min_feats END)"""


def score_sql(tests: str, more: str = "", tag: str = "") -> str:
    """CTE pred from rate and from `tests`, which has a row for each row to score: symbol, horizon, date, label, fit_rn (its model's row), run,
    test_days, test_end. more: further conditions on these rows (d) and the rates (m)."""
    own = "CASE m.f " + " ".join(f"WHEN '{f}' THEN CASE d.{f} WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END" for f in NAMES) + " END"
    keys = ", ".join("d.horizon" if k == "horizon" else f"m.{k}" for k in KEYS)
    return f"""
pred0{tag} AS (
  SELECT d.symbol, d.date, {keys}, d.run, d.test_days, sum({own}) AS total, d.label AS test_pos_n, (245 * m.train_years)::INT AS train_n, train_start, m.date AS train_end,
    d.test_end, count(*)::INT AS n_features
  FROM ({tests}) d JOIN rate{tag} m ON d.symbol = m.symbol AND d.horizon = m.horizon AND d.fit_rn = m.rn {more} GROUP BY ALL),
pred{tag} AS (
  SELECT symbol, date, {K}, run, test_days, round_even(round_even(raw / 0.05::DOUBLE, 0) * 0.05::DOUBLE * 100, 0) / 100 AS pred, (raw >= 0.5)::INT AS pred_class, test_pos_n, ((raw >= 0.5)::INT = test_pos_n)::INT AS acc,
    train_n, train_start, train_end, test_end, n_features
  FROM (SELECT *, CASE WHEN model = 'margin' THEN 1 / (1 + exp(-((total - n_features * 500000)::DOUBLE * 4 / 1e6::DOUBLE))) ELSE total::DOUBLE / n_features / 1e6::DOUBLE END AS raw FROM pred0{tag}))"""


FOLD_ENDS = f"n - horizon - rn - {TEST} - horizon >= 0 AND (n - horizon - rn - {TEST} - horizon) % {TEST} = 0"
TESTS = f"""SELECT l.*, ((n - horizon - rn) // {TEST})::INT AS run, {TEST}::INT AS test_days, n - horizon - ((n - horizon - rn) // {TEST}) * {TEST} - {TEST} - horizon AS fit_rn,
    min(CASE WHEN (n - horizon - rn) % {TEST} = 0 THEN date END) OVER (PARTITION BY symbol, horizon ORDER BY rn ROWS BETWEEN CURRENT ROW AND {TEST - 1} FOLLOWING) AS test_end FROM l WHERE rn <= n - horizon"""
PRED = "WITH " + BARS.strip() + "," + base_sql(CONFIGS) + "," + fit_sql(CONFIGS, FOLD_ENDS) + "," + score_sql(TESTS)
COLUMNS = f"symbol, date, {K}, run, test_days, pred, pred_class, test_pos_n, acc, train_n, train_start, train_end, test_end, n_features"
OTHER_KEYS = [k for k in KEYS if k != "horizon"]
ENDS = f"""
past AS (SELECT * FROM pred WHERE date < DATE '{KNOWN_UNTIL}'),
last AS (SELECT symbol, {K}, max(date) AS last_date FROM past GROUP BY ALL),
ends AS (
  SELECT last.*, l.rn AS last_rn, l.n - l.horizon - l.rn AS pending, l.rn - l.horizon AS fit_rn
  FROM last JOIN l ON l.symbol = last.symbol AND l.horizon = last.horizon AND l.date = last.last_date WHERE l.n - l.horizon - l.rn > 2)"""
FRESH = f"""SELECT l.*, ends.fit_rn, 0::INT AS run, pending::INT AS test_days, {', '.join(f'ends.{k} AS c_{k}' for k in OTHER_KEYS)}, max(l.date) OVER (PARTITION BY l.symbol, l.horizon) AS test_end
    FROM l JOIN ends ON l.symbol = ends.symbol AND l.horizon = ends.horizon WHERE l.rn > last_rn AND l.label IS NOT NULL"""
SAME = "AND " + " AND ".join(f"d.c_{k} = m.{k}" for k in OTHER_KEYS)


NEWEST = "SELECT l.*, 0::INT AS run, horizon::INT AS test_days, n - 2 * horizon AS fit_rn, max(date) OVER (PARTITION BY symbol, horizon) AS test_end FROM l WHERE rn > n - horizon"
START = "WITH " + BARS.strip() + ","
ORACLE = {
    "run_grid": PRED + f"\nSELECT {COLUMNS} FROM pred",
    "selection_modes": START + base_sql(MODE_CONFIGS) + "," + fit_sql(MODE_CONFIGS, FOLD_ENDS) + f"\nSELECT symbol, horizon, ((n - horizon - rn - {TEST} - horizon) // {TEST})::INT AS run, {', '.join(OTHER_KEYS)}, f AS feature FROM rate",
    "score_unlabelled": START + base_sql(CONFIGS) + "," + fit_sql(CONFIGS, "rn = n - 2 * horizon") + "," + score_sql(NEWEST) + "\nSELECT " + COLUMNS.replace("test_pos_n, acc, ", "") + " FROM pred",
    "score_pending": PRED + "," + ENDS + "," + fit_sql(CONFIGS, "(symbol, horizon, rn) IN (SELECT (symbol, horizon, fit_rn) FROM ends)", "2") + "," + score_sql(FRESH, SAME, "2") + f"\nSELECT {COLUMNS} FROM pred2",
    "pending_history": PRED + "," + ENDS + "," + fit_sql(CONFIGS, "(symbol, horizon, rn) IN (SELECT (symbol, horizon, fit_rn) FROM ends)", "2") + "," + score_sql(FRESH, SAME, "2") + f"\nSELECT {COLUMNS} FROM past UNION ALL SELECT {COLUMNS} FROM pred2",
    "runs_to_replay": PRED + f"""
SELECT l.symbol, l.horizon, first_date, count(*) AS days, (count(*) // {TEST})::BIGINT AS runs
FROM l JOIN (SELECT symbol, horizon, min(date) AS first_date FROM pred GROUP BY symbol, horizon) p ON l.symbol = p.symbol AND l.horizon = p.horizon
WHERE label IS NOT NULL AND date >= first_date GROUP BY l.symbol, l.horizon, first_date""",
}
IMPORTANCE = START + base_sql(MODE_CONFIGS[:1]) + "," + fit_sql(MODE_CONFIGS[:1], FOLD_ENDS) + f""",
i AS (SELECT symbol, horizon, ((n - horizon - rn - {TEST} - horizon) // {TEST})::INT AS run, f AS feature, {sql_rnd('gain / 242.0::DOUBLE', 6)} AS pi_mean FROM wg)"""
ORACLE["fold_accuracy"] = PRED + f"\nSELECT symbol, {K}, run, count(acc) AS days, {sql_rnd('avg(acc)', 6)} AS accuracy FROM pred GROUP BY ALL"
ORACLE["distinct_sets"] = PRED + "\nSELECT DISTINCT horizon, features FROM pred"
ORACLE["grid_importance"] = IMPORTANCE + "\nSELECT * FROM i"
ORACLE["grid_importance_rollup"] = IMPORTANCE + f"\nSELECT symbol, horizon, feature, {sql_rnd('sum(pi_mean)', 6)} AS pi_sum, count(*) AS n, {sql_rnd('avg(pi_mean)', 6)} AS pi_avg FROM i GROUP BY symbol, horizon, feature"
ORACLE["grid_importance_chosen"] = IMPORTANCE + """,
k AS (SELECT *, count_if(pi_mean > 0.03) OVER (PARTITION BY symbol, horizon, run) AS good, row_number() OVER (PARTITION BY symbol, horizon, run ORDER BY pi_mean DESC, feature)::INT AS rank FROM i)
SELECT symbol, horizon, run, feature, pi_mean, rank FROM k WHERE pi_mean > 0.03 OR good < 2 AND rank <= 2"""

FULL = START + base_sql(FULL_CONFIGS) + "," + fit_sql(FULL_CONFIGS, FOLD_ENDS) + "," + score_sql(TESTS)
ORACLE["full_grid_models"] = FULL + """
SELECT horizon, model, pi_size, count(*) AS n, sum(acc)::BIGINT AS hits, sum(n_features)::BIGINT AS features_used, max(run) AS oldest_run, sum(round_even(pred * 100, 0)::BIGINT)::BIGINT AS pred_sum
FROM pred GROUP BY horizon, model, pi_size"""
