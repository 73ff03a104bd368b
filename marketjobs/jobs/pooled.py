"""Queries on models over all symbols, permutation importance as joins, and exact quantiles, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.rolling import div, lag, lead, rnd, without_inf
from ..operators import boost, folds, permute
from ..sources.shared import written
from ..sources.tables import bars_daily
from .daily import BARS, S
from .daily import div as sql_div
from .daily import rnd as sql_rnd

FEATURES = ["ret1", "gap", "span", "vol"]
SIDES = ["up", "body", "busy"]
YEARS, STEP, TEST, PURGE = 1, 5, 5, 5
FRACTIONS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, rn, n, label (5 rows ahead) and four features of the days with known labels."""
    bars = bars_daily(spark, sf_dir)
    label = F.when(lead("close", 5) > F.col("close"), 1).when(lead("close", 5) <= F.col("close"), 0)
    features = {"ret1": div(F.col("close"), lag("close")), "gap": div(F.col("open"), lag("close")), "span": div(F.col("high"), F.col("low")), "vol": F.col("volume").cast("double")}
    out = bars.select("symbol", "date", label.alias("label"), *[x.alias(n) for n, x in features.items()])
    return folds.numbered(without_inf(out, FEATURES))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all folds with binned features; bins are cut over each symbol's first year, before any test row."""
    binned = boost.with_bins(rows(spark, sf_dir), FEATURES, F.col("rn") <= folds.DAYS_A_YEAR * YEARS)
    binned = written(binned.select("symbol", "date", "rn", "n", "label", *[f"b{i}" for i in range(len(FEATURES))]), "binned")
    return folds.with_folds(binned, YEARS, None, STEP, TEST, PURGE)


def first_tree(spark: SparkSession, sf_dir: str):
    return boost.grown(written(boost.cells_of(folded(spark, sf_dir), len(FEATURES)), "cells"), len(FEATURES))


def boost_splits(spark, sf_dir):
    """The splits of the first tree of each fold."""
    _, levels = first_tree(spark, sf_dir)
    out = levels[0].unionByName(levels[1])
    return out.select("run", "node", F.element_at(F.lit(FEATURES), F.col("f") + 1).alias("feature"), "cut", "gain")


def boost_leaves(spark, sf_dir):
    """The leaves of the first tree of each fold."""
    cells, _ = first_tree(spark, sf_dir)
    return boost.leaf_values(cells).select("run", "node", "n", rnd(F.col("value"), 9).alias("value"))


def pooled_fit(spark, sf_dir):
    """Test rows of all folds, scored by boosted trees of the fold over all symbols."""
    return boost.walk_forward(folded(spark, sf_dir), len(FEATURES))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numbered rows with three features of two values: up on the day before, up in the day, more volume than the day before."""
    bars = bars_daily(spark, sf_dir)
    label = F.when(lead("close", 5) > F.col("close"), 1).when(lead("close", 5) <= F.col("close"), 0)
    more = {"up": F.col("close") > lag("close"), "body": F.col("close") > F.col("open"), "busy": F.col("volume") > lag("volume")}
    return folds.numbered(bars.select("symbol", "date", label.alias("label"), *[F.coalesce(x, F.lit(False)).cast("int").alias(c) for c, x in more.items()]))


def cell_importance(spark, sf_dir):
    """Permutation importance over the newest train rows of each fold."""
    train = folds.with_folds(sides(spark, sf_dir), YEARS, None, STEP, TEST, PURGE).where("part = 'train'")
    end = F.col("n") - F.col("run") * STEP - TEST - PURGE
    return permute.importance(train.where(F.col("rn") > end - permute.ROWS), SIDES)


def close_quantiles(spark, sf_dir):
    found = quantiles(bars_daily(spark, sf_dir), ["symbol"], "close", FRACTIONS)
    return found.select("symbol", F.col("n").alias("days"), F.posexplode("quantiles").alias("i", "x")).select("symbol", "days", "i", rnd(F.col("x"), 4).alias("close"))


QUERIES = {f.__name__: f for f in (boost_splits, boost_leaves, pooled_fit, cell_importance, close_quantiles)}

LABEL = f"CASE WHEN lead(close, 5) OVER {S} > close THEN 1 WHEN lead(close, 5) OVER {S} <= close THEN 0 END AS label"
PLAN = f"""
size AS (SELECT symbol, max(rn) AS n FROM num GROUP BY symbol),
plan AS (
  SELECT symbol, run, n - run * {STEP} AS test_end, n - run * {STEP} - {TEST + PURGE} AS train_end
  FROM size, unnest(range(0, n // {STEP} + 1)) u(run) WHERE n - run * {STEP} - {TEST + PURGE + folds.DAYS_A_YEAR * YEARS} >= 0)"""
BINS = ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE len(list_filter(c{i}, lambda e: e < {c})) END AS b{i}" for i, c in enumerate(FEATURES))
CUTS = ", ".join(f"quantile_cont({c}, {[k / boost.BINS for k in range(1, boost.BINS)]}) AS c{i}" for i, c in enumerate(FEATURES))
CELL = ", ".join(f"b{i}" for i in range(len(FEATURES)))
ONE = f"{boost.ONE}::DOUBLE"


def sql_splits(level: int) -> str:
    """CTEs of the best splits of a level, and of the cells below it."""
    hist = " UNION ALL ".join(f"SELECT run, node, {i} AS f, b{i} AS bin, n, g, h FROM k{level}" for i in range(len(FEATURES)))
    term = lambda g, h: f"(({g})::DOUBLE / {ONE}) * (({g})::DOUBLE / {ONE}) / (({h})::DOUBLE / {ONE} + 1.0::DOUBLE)"
    gain = f"floor(({term('gl', 'hl')} + {term('gt - gl', 'ht - hl')} - {term('gt', 'ht')}) * 1e9::DOUBLE + 0.5::DOUBLE)::BIGINT"
    own = "(PARTITION BY run, node, f"
    sums = ", ".join(f"sum({c}) OVER {own} ORDER BY bin)::BIGINT AS {c}l, sum({c}) OVER {own})::BIGINT AS {c}t" for c in "ngh")
    value = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(len(FEATURES))) + " END"
    return f"""
h{level} AS (SELECT run, node, f, bin, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM ({hist}) GROUP BY ALL),
g{level} AS (SELECT run, node, f, bin AS cut, {gain} AS gain, nl, nt FROM (SELECT run, node, f, bin, {sums} FROM h{level})),
s{level} AS (SELECT run, node, f, cut, gain FROM g{level} WHERE nl > 0 AND nl < nt AND gain > 0 QUALIFY row_number() OVER (PARTITION BY run, node ORDER BY gain DESC, f, cut) = 1),
k{level + 1} AS (SELECT k.run, 2 * k.node + coalesce(({value} > cut)::INT, 0) AS node, {CELL}, n, g, h FROM k{level} k LEFT JOIN s{level} s ON s.run = k.run AND s.node = k.node)"""


TREE = "WITH " + BARS.strip() + f""",
x AS (SELECT symbol, date, {LABEL}, {sql_div('close', f'lag(close) OVER {S}')} AS ret1, {sql_div('open', f'lag(close) OVER {S}')} AS gap, {sql_div('high', 'low')} AS span, volume::DOUBLE AS vol FROM bars),
num AS (SELECT *, row_number() OVER {S} AS rn FROM x WHERE label IS NOT NULL),{PLAN},
cut AS (SELECT {CUTS} FROM num WHERE rn <= {folds.DAYS_A_YEAR * YEARS}),
bin AS (SELECT symbol, rn, label, {BINS} FROM num, cut),
cell AS (
  SELECT run, {CELL}, sum((rn <= train_end)::INT)::BIGINT AS n, sum(CASE WHEN rn <= train_end THEN label ELSE 0 END)::BIGINT AS ups
  FROM bin JOIN plan USING (symbol) WHERE rn > train_end - {folds.DAYS_A_YEAR * YEARS} AND rn <= train_end OR rn > test_end - {TEST} AND rn <= test_end GROUP BY ALL),
base AS (SELECT run, greatest(0.01::DOUBLE, least(0.99::DOUBLE, sum(ups)::DOUBLE / sum(n)::DOUBLE)) AS p FROM cell GROUP BY run HAVING sum(n) > 0),
prob AS (SELECT run, 1 / (1 + exp(-ln(p / (1 - p)))) AS p FROM base),
k0 AS (
  SELECT run, 1 AS node, {CELL}, n, floor((ups - n * p) * {ONE} + 0.5::DOUBLE)::BIGINT AS g, floor((n * p * (1 - p)) * {ONE} + 0.5::DOUBLE)::BIGINT AS h FROM cell JOIN prob USING (run)),""" + sql_splits(0) + "," + sql_splits(1)
NAMES = str(FEATURES)
DRAWS = f"(SELECT f, s FROM unnest(range(0, {len(SIDES)})) a(f), unnest(range(0, {permute.SHUFFLES})) b(s))"
OTHER = ", ".join(f"CASE WHEN a.f = {i} THEN b.own ELSE a.{c} END AS {c}" for i, c in enumerate(SIDES))
SIDE = ", ".join(SIDES)
SCORE = "(coalesce(sum(CASE WHEN says = 1 THEN ones ELSE 0 END)::DOUBLE / nullif(sum(ones), 0), 0) + coalesce(sum(CASE WHEN says = 0 THEN n - ones ELSE 0 END)::DOUBLE / nullif(sum(n - ones), 0), 0)) / ((sum(ones) > 0)::INT + (sum(n - ones) > 0)::INT)"
ORACLE = {
    "boost_splits": TREE + f"\nSELECT run, node, ({NAMES})[f + 1] AS feature, cut, gain FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1)",
    "boost_leaves": TREE + f"\nSELECT run, node, sum(n)::BIGINT AS n, {sql_rnd(f'sum(g)::DOUBLE / {ONE} / (sum(h)::DOUBLE / {ONE} + 1.0::DOUBLE) * {boost.RATE}::DOUBLE', 9)} AS value FROM k2 GROUP BY run, node",
    "close_quantiles": "WITH " + BARS.strip() + f""",
q AS (SELECT symbol, count(*) AS days, quantile_cont(close::DOUBLE, {FRACTIONS}) AS q FROM bars GROUP BY symbol)
SELECT symbol, days, i::INT AS i, {sql_rnd('q[i + 1]', 4)} AS close FROM q, unnest(range(0, {len(FRACTIONS)})) u(i)""",
    "cell_importance": "WITH " + BARS.strip() + f""",
x AS (SELECT symbol, date, {LABEL}, coalesce(close > lag(close) OVER {S}, false)::INT AS up, coalesce(close > open, false)::INT AS body, coalesce(volume > lag(volume) OVER {S}, false)::INT AS busy FROM bars),
num AS (SELECT *, row_number() OVER {S} AS rn FROM x WHERE label IS NOT NULL),{PLAN},
fold AS (SELECT symbol, run, rn, label, {SIDE} FROM num JOIN plan USING (symbol) WHERE rn <= train_end AND rn > train_end - {min(permute.ROWS, folds.DAYS_A_YEAR * YEARS)}),
cells AS (SELECT symbol, run, {SIDE}, count(*) AS n, sum(label) AS ones, ((sum(label) + 1) * 2 >= count(*) + 2)::INT AS says FROM fold GROUP BY ALL),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, run, f, s ORDER BY rn) AS i, row_number() OVER (PARTITION BY symbol, run, f, s ORDER BY draw, rn) AS j
  FROM (SELECT fold.*, f, s, CASE f {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(SIDES))} END AS own, md5('{permute.SEED}:' || f || ':' || s || ':' || symbol || ':' || rn) AS draw FROM fold, {DRAWS} d)),
mixed AS (SELECT a.symbol, a.run, a.f, a.s, a.label, {OTHER} FROM drawn a JOIN drawn b ON a.symbol = b.symbol AND a.run = b.run AND a.f = b.f AND a.s = b.s AND a.i = b.j),
asked AS (
  SELECT m.*, coalesce(says, 1) AS says FROM (SELECT symbol, run, f, s, {SIDE}, count(*) AS n, sum(label) AS ones FROM mixed GROUP BY ALL) m
  LEFT JOIN (SELECT symbol, run, {SIDE}, says FROM cells) USING (symbol, run, {SIDE})),
drops AS (
  SELECT symbol, run, f, s, base - score AS d FROM (SELECT symbol, run, f, s, {SCORE} AS score FROM asked GROUP BY ALL) JOIN (SELECT symbol, run, {SCORE} AS base FROM cells GROUP BY ALL) USING (symbol, run))
SELECT symbol, run, ({SIDES})[f + 1] AS feature, {sql_rnd(f'sum(d ORDER BY s) / {permute.SHUFFLES}', 6)} AS pi_mean,
  {sql_rnd(f'sqrt(greatest(0.0::DOUBLE, sum(d * d) / {permute.SHUFFLES} - (sum(d) / {permute.SHUFFLES}) * (sum(d) / {permute.SHUFFLES})))', 6)} AS pi_std FROM drops GROUP BY symbol, run, f""",
}
