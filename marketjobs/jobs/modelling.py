"""Queries on folds, feature sets and correlations, and the same in SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import div, lag, lead, rnd
from ..operators import folds, prune
from ..sources.tables import bars_daily
from .daily import BARS, S
from .daily import div as sql_div
from .daily import rnd as sql_rnd

YEARS, STEP, TEST, PURGE = 1, 5, 5, 5
FEATURES = ["ret1", "ret2", "gap", "span", "vol"]
REPRESENTED = 0.3


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, label (5 rows ahead), bucket (a feature of four values)."""
    bars = bars_daily(spark, sf_dir)
    bucket = F.when(F.col("close") > lag("close"), 1).otherwise(0) + F.when(F.col("close") > F.col("open"), 2).otherwise(0)
    label = F.when(lead("close", 5) > F.col("close"), 1).when(lead("close", 5) <= F.col("close"), 0)
    return bars.select("symbol", "date", label.alias("label"), bucket.alias("bucket"))


def numbered(spark, sf_dir):
    return folds.numbered(labelled(spark, sf_dir))


def fold_plan(spark, sf_dir):
    sizes = numbered(spark, sf_dir).groupBy("symbol").agg(F.max("rn").alias("n"))
    return folds.plan(sizes, YEARS, None, STEP, TEST, PURGE)


def folded(spark, sf_dir):
    return folds.with_folds(numbered(spark, sf_dir), YEARS, None, STEP, TEST, PURGE)


def fold_rows(spark, sf_dir):
    return folded(spark, sf_dir).select("symbol", "date", "run", "part", "label")


def fold_class_dist(spark, sf_dir):
    return folds.class_dist(folded(spark, sf_dir), "symbol")


def walk_forward_rate(spark, sf_dir):
    return folds.rate_model(folded(spark, sf_dir), "bucket", "symbol").select("symbol", "date", "run", "label", "pred", "acc")


def grid(spark, sf_dir):
    """The configurations of each symbol that has rows for them."""
    params = folds.grid(spark, horizon=[2, 5], train_years=[1, 3], min_feats=[5, 10])
    sizes = numbered(spark, sf_dir).groupBy("symbol").agg(F.max("rn").alias("n"))
    return sizes.join(params, F.col("n") >= F.col("train_years") * folds.DAYS_A_YEAR + F.col("horizon")).select("symbol", "horizon", "train_years", "min_feats")


def catalog(spark, sf_dir):
    """Sets of columns from the data: a set per order status, its columns the priorities in order, some in several sets."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lower("o_orderstatus").alias("set_name"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")).alias("col_name"), "o_orderkey")
    return rows.groupBy("set_name", "col_name").agg(F.min("o_orderkey").alias("pos"))


def set_pairs(spark, sf_dir):
    return prune.set_pairs(catalog(spark, sf_dir))


def resolve_sets(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return prune.resolve_sets(prune.set_pairs(c), c).select("name", F.array_join("cols", ",").alias("cols"))


def normalize_names(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("['"), "o_orderpriority", F.lit("', "), "o_orderstatus", F.lit("_X]")).alias("name")).distinct()
    return prune.normalized(names)


def split_sizes(spark, sf_dir):
    """Packed sizes made of the orders' prices and statuses."""
    size = F.concat((F.floor(F.col("o_totalprice") / 50000) / 2).cast("string"), F.when(F.col("o_orderstatus") == "F", "-r").when(F.col("o_orderstatus") == "P", "-x").otherwise(""))
    return prune.split_sizes(spark.read.parquet(f"{sf_dir}/orders.parquet").select(size.alias("packed")).distinct(), "packed")


def features(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    one = lag("close")
    return bars.select("symbol", div(F.col("close"), one).alias("ret1"), div(F.col("close"), lag("close", 2)).alias("ret2"), div(F.col("open"), one).alias("gap"), div(F.col("high"), F.col("low")).alias("span"), F.col("volume").cast("double").alias("vol"), div(lead("close", 5), F.col("close")).alias("ahead"))


def corr_pairs(spark, sf_dir):
    return prune.correlations(features(spark, sf_dir), FEATURES).select("a", "b", rnd(F.col("r"), 6).alias("r"))


LAGS = 12


def corr_wide(spark, sf_dir):
    """Correlations of prices and volumes with each other up to LAGS rows before: 60 columns, 1,770 pairs, one pass."""
    bars = bars_daily(spark, sf_dir)
    rows = bars.select(*[lag(c, k).alias(f"{c}_{k}") for c in ("open", "high", "low", "close", "volume") for k in range(1, LAGS + 1)])
    return prune.correlations_wide(rows, rows.columns).select("a", "b", rnd(F.col("r"), 6).alias("r"))


def corr_prune(spark, sf_dir):
    return prune.pruned(prune.correlations(features(spark, sf_dir), FEATURES), 0.5)


def target_corr(spark, sf_dir):
    return prune.target_corr(features(spark, sf_dir), FEATURES, "ahead").select("col", "pos", rnd(F.col("r"), 6).alias("r"))


def representatives(spark, sf_dir):
    rows = features(spark, sf_dir)
    return prune.representatives(prune.correlations(rows, FEATURES), prune.target_corr(rows, FEATURES, "ahead"), REPRESENTED)


QUERIES = {f.__name__: f for f in (split_sizes, representatives, fold_plan, fold_rows, fold_class_dist, walk_forward_rate, grid, set_pairs, resolve_sets, normalize_names, corr_pairs, corr_wide, corr_prune, target_corr)}

ROWS = "WITH " + BARS.strip() + f""",
lab AS (
  SELECT symbol, date, CASE WHEN lead(close, 5) OVER {S} > close THEN 1 WHEN lead(close, 5) OVER {S} <= close THEN 0 END AS label,
    CASE WHEN close > lag(close) OVER {S} THEN 1 ELSE 0 END + CASE WHEN close > open THEN 2 ELSE 0 END AS bucket FROM bars),
num AS (SELECT *, (row_number() OVER {S})::INT AS rn FROM lab WHERE label IS NOT NULL),
size AS (SELECT symbol, max(rn) AS n FROM num GROUP BY symbol),
plan AS (
  SELECT symbol, run, te - {TEST} + 1 - 1 - {PURGE} - {245 * YEARS} + 1 AS train_start, te - {TEST} - {PURGE} AS train_end, te - {TEST} + 1 AS test_start, te AS test_end
  FROM (SELECT symbol, run::INT AS run, (n - run * {STEP})::INT AS te FROM size, unnest(range(0, n // {STEP} + 1)) u(run)) WHERE te - {TEST} - {PURGE} - {245 * YEARS} + 1 >= 1),
fold AS (
  SELECT num.*, run, 'test' AS part FROM num JOIN plan ON num.symbol = plan.symbol AND rn BETWEEN test_start AND test_end
  UNION ALL SELECT num.*, run, 'train' FROM num JOIN plan ON num.symbol = plan.symbol AND rn BETWEEN train_start AND train_end)"""
CAT = "WITH cat AS (SELECT lower(o_orderstatus) AS set_name, lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS col_name, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2),\npairs AS (SELECT a.s || '-' || b.s AS name FROM (SELECT DISTINCT set_name AS s FROM cat) a JOIN (SELECT DISTINCT set_name AS s FROM cat) b ON a.s < b.s)"
FEAT = "WITH " + BARS.strip() + f",\nx AS (SELECT {sql_div('close', f'lag(close) OVER {S}')} AS ret1, {sql_div('close', f'lag(close, 2) OVER {S}')} AS ret2, {sql_div('open', f'lag(close) OVER {S}')} AS gap, {sql_div('high', 'low')} AS span, volume::DOUBLE AS vol, {sql_div(f'lead(close, 5) OVER {S}', 'close')} AS ahead FROM bars)"
PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
ORACLE = {
    "fold_plan": ROWS + "\nSELECT * FROM plan",
    "fold_rows": ROWS + "\nSELECT symbol, date, run::BIGINT AS run, part, label FROM fold",
    "fold_class_dist": ROWS + f"\nSELECT symbol, run::BIGINT AS run, count(*) AS test_n, count_if(label = 1) AS pos_n, count_if(label = 0) AS neg_n, {sql_rnd('count_if(label = 1)::DOUBLE / count(*)', 6)} AS pos_frac FROM fold WHERE part = 'test' GROUP BY symbol, run",
    "walk_forward_rate": ROWS + f""",
t AS (SELECT symbol, run, bucket, count(*) AS seen, sum(label) AS ups FROM fold WHERE part = 'train' GROUP BY ALL),
p AS (SELECT f.symbol, f.date, f.run, f.label, {sql_rnd('(coalesce(ups, 0) + 1) / (coalesce(seen, 0) + 2.0::DOUBLE)', 6)} AS pred FROM fold f LEFT JOIN t ON f.symbol = t.symbol AND f.run = t.run AND f.bucket = t.bucket WHERE part = 'test')
SELECT symbol, date, run::BIGINT AS run, label, pred, ((pred >= 0.5)::INT = label)::INT AS acc FROM p""",
    "grid": ROWS + "\nSELECT symbol, h AS horizon, y AS train_years, m AS min_feats FROM size, (VALUES (2::BIGINT), (5)) a(h), (VALUES (1::BIGINT), (3)) b(y), (VALUES (5::BIGINT), (10)) c(m) WHERE n >= y * 245 + h",
    "set_pairs": CAT + "\nSELECT name FROM pairs",
    "resolve_sets": CAT + """,
p AS (SELECT name, col_name, min({'a': i, 'b': pos}) AS k FROM (SELECT name, i, string_split(name, '-')[i] AS s FROM pairs, unnest(range(1, 3)) u(i)) JOIN cat ON s = set_name GROUP BY name, col_name)
SELECT name, string_agg(col_name, ',' ORDER BY k) AS cols FROM p GROUP BY name""",
    "normalize_names": """WITH n AS (SELECT DISTINCT '[''' || o_orderpriority || ''', ' || o_orderstatus || '_X]' AS name FROM orders)
SELECT name, regexp_replace(regexp_replace(lower(name), '[\\[\\]''"\\s]', '', 'g'), '[,_]+', '-', 'g') AS clean FROM n""",
    "split_sizes": r"""WITH p AS (SELECT DISTINCT (floor(o_totalprice / 50000) / 2)::DOUBLE::VARCHAR || CASE o_orderstatus WHEN 'F' THEN '-r' WHEN 'P' THEN '-x' ELSE '' END AS packed FROM orders)
SELECT packed, CASE WHEN ends_with(packed, '-r') THEN 'separately' WHEN regexp_matches(packed, '^[0-9.]+$') THEN 'together' END AS pi_handling, try_cast(regexp_replace(packed, '-r$', '') AS DOUBLE) AS pi_size FROM p""",
    "corr_pairs": FEAT + "\n" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sql_rnd(f'corr({a}, {b})', 6)} AS r FROM x" for a, b in PAIRS),
    "corr_prune": FEAT + "\nSELECT DISTINCT b AS dropped FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS b, corr({a}, {b}) AS r FROM x" for a, b in PAIRS) + ") WHERE abs(r) > 0.5",
    "representatives": FEAT.replace("WITH ", "WITH RECURSIVE ", 1) + ",\ntc AS (" + " UNION ALL ".join(f"SELECT '{a}' AS col, {i} AS pos, coalesce(abs(corr({a}, ahead)), 0) AS score FROM x" for i, a in enumerate(FEATURES)) + f"""),
pr AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM x" for a, b in PAIRS)}),
li AS (SELECT a, b FROM pr WHERE abs(r) > {REPRESENTED} UNION ALL SELECT b, a FROM pr WHERE abs(r) > {REPRESENTED} UNION ALL SELECT col, col FROM tc),
cl AS (SELECT a, list(b) AS members, arg_max(b, {{'s': score, 'p': -tc.pos}}) AS best FROM li JOIN tc ON b = col GROUP BY a),
st AS (SELECT pos, a, members, best FROM cl JOIN tc ON a = col),
go AS (
  SELECT -1 AS place, []::VARCHAR[] AS used, []::VARCHAR[] AS kept
  UNION ALL SELECT place + 1, CASE WHEN list_contains(used, a) THEN used ELSE list_concat(used, members) END, CASE WHEN list_contains(used, a) THEN kept ELSE list_append(kept, best) END FROM go JOIN st ON pos = place + 1)
SELECT DISTINCT unnest(kept) AS col FROM go WHERE place = {len(FEATURES) - 1}""",
    "target_corr": FEAT + "\n" + " UNION ALL ".join(f"SELECT '{a}' AS col, {i} AS pos, {sql_rnd(f'corr({a}, ahead)', 6)} AS r FROM x" for i, a in enumerate(FEATURES)),
}
WIDE = [f"{c}_{k}" for c in ("open", "high", "low", "close", "volume") for k in range(1, LAGS + 1)]
ORACLE["corr_wide"] = "WITH " + BARS.strip() + f""",
x AS (SELECT {', '.join(f"(lag({w.rpartition('_')[0]}, {w.rpartition('_')[2]}) OVER {S})::DOUBLE AS {w}" for w in WIDE)} FROM bars),
c AS (SELECT {', '.join(f"corr({a}, {b}) AS r{i}_{j}" for (i, a), (j, b) in combinations(enumerate(WIDE), 2))} FROM x)
SELECT unnest({[a for a, _ in combinations(WIDE, 2)]}) AS a, unnest({[b for _, b in combinations(WIDE, 2)]}) AS b, unnest([{', '.join(sql_rnd(f"r{i}_{j}", 6) for i, j in combinations(range(len(WIDE)), 2))}]) AS r FROM c"""
