"""Pooled boosting, permutation importance as joins, and exact quantiles against NumPy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketjobs.functions.quantiles import quantiles
from marketjobs.operators import boost, fit, folds, permute

RNG = np.random.default_rng(17)


def numpy_boost(b: np.ndarray, n: np.ndarray, ups: np.ndarray, rounds: int, depth: int):
    """The scores of the cells of one fold, and the splits (round, node, f, cut)."""
    p = min(0.99, max(0.01, ups.sum() / n.sum()))
    score, splits = np.full(len(n), np.log(p / (1 - p))), []
    for r in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = np.floor((ups - n * q) * boost.ONE + 0.5), np.floor(n * q * (1 - q) * boost.ONE + 0.5)
        node = np.ones(len(n), int)
        term = lambda a, c: (a / boost.ONE) ** 2 / (c / boost.ONE + 1)
        for _ in range(depth):
            new = 2 * node
            for k in np.unique(node):
                at, best = node == k, (0, None)
                for f in range(b.shape[1]):
                    for cut in range(b[:, f].max()):
                        left = at & (b[:, f] <= cut)
                        if 0 < n[left].sum() < n[at].sum() and (at & (b[:, f] == cut)).any():
                            gain = np.floor((term(g[left].sum(), h[left].sum()) + term(g[at].sum() - g[left].sum(), h[at].sum() - h[left].sum()) - term(g[at].sum(), h[at].sum())) * 1e9 + 0.5)
                            if gain > best[0]:
                                best = (gain, (f, cut))
                if best[1]:
                    splits.append((r, k, *best[1]))
                    new[at] += b[at, best[1][0]] > best[1][1]
            node = new
        for k in np.unique(node):
            at = node == k
            score[at] += g[at].sum() / boost.ONE / (h[at].sum() / boost.ONE + 1) * boost.RATE
    return score, splits


def cells(spark):
    rows, own = [], {}
    for run in range(3):
        b = np.unique(RNG.integers(0, 4, (40, 3)), axis=0)
        n = RNG.integers(0, 9, len(b))
        n[:3] = 0  # test rows only
        ups = RNG.binomial(n, 0.2 + 0.15 * b[:, 0])
        own[run] = (b, n, ups)
        p = min(0.99, max(0.01, ups.sum() / n.sum()))
        rows += [(run, *map(int, x), int(m), int(u), float(np.log(p / (1 - p)))) for x, m, u in zip(b, n, ups, strict=True)]
    return spark.createDataFrame(rows, "run long, b0 int, b1 int, b2 int, n long, ups long, score double"), own


def test_same_trees_as_numpy(spark):
    df, own = cells(spark)
    scored = {(r["run"], r["b0"], r["b1"], r["b2"]): r["score"] for r in boost.boosted(df, 3, rounds=4).collect()}
    _, levels = boost.grown(df, 3)
    found = {(r["run"], r["node"]): (r["f"], r["cut"]) for level in levels for r in level.collect()}
    for run, (b, n, ups) in own.items():
        score, splits = numpy_boost(b, n, ups, 4, 2)
        np.testing.assert_allclose([scored[(run, *map(int, x))] for x in b], score, rtol=1e-9)
        assert {(k, f, c) for r, k, f, c in splits if r == 0} == {(k, *v) for (r, k), v in found.items() if r == run}


def test_pooled_model_learns_and_scores_every_test_row(spark):
    n, f = 400, folds.Folds(train=100, test=5, step=20, purge=5)
    x = RNG.standard_normal((2 * n, 2))
    label = (RNG.random(2 * n) < np.where(x[:, 0] > 0, 0.85, 0.15)).astype(int)
    rows = [("ab"[i // n], int(i % n), n, int(label[i]), float(x[i, 0]) if i % 17 else None, float(x[i, 1])) for i in range(2 * n)]
    df = spark.createDataFrame(rows, "symbol string, k int, n long, label int, x double, y double").withColumn("rn", F.col("k") + 1).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")))
    binned = boost.with_bins(df, ["x", "y"], F.col("rn") <= 100)
    assert binned.where("x is null").select("b0").distinct().collect() == [(0,)] and binned.agg(F.max("b0")).first()[0] == boost.BINS - 1
    out = boost.walk_forward(folds.with_folds(binned, 1, None, 20, 5, 5, days=100), 2, rounds=5).toPandas()
    assert len(out) == 2 * 5 * (f.last_run(n) + 1)
    assert ((out["pred"] >= 0.5) == (out["label"] == 1)).mean() > 0.75


def test_importance_by_joins(spark):
    """The same draws, places and scores in plain Python."""
    rows = [(s, run, rn, int(RNG.random() < (0.8 if a else 0.2)), a, c) for s in "ab" for run in range(2) for rn in range(60) for a, c in [(int(RNG.random() < 0.5), int(RNG.integers(0, 3)))]]
    df = spark.createDataFrame(rows, "symbol string, run long, rn int, label int, a int, c int")
    got = {(r["symbol"], r["run"], r["feature"]): (r["pi_mean"], r["pi_std"]) for r in permute.importance(df, ["a", "c"]).collect()}
    for s in "ab":
        for run in range(2):
            fold = [r for r in rows if r[:2] == (s, run)]
            seen: dict = {}
            for r in fold:
                seen.setdefault(r[4:], []).append(r[3])
            says = lambda cell: int((sum(seen.get(cell, [])) + 1) * 2 >= len(seen.get(cell, [])) + 2)  # noqa: B023, E731
            for f, name in enumerate(("a", "c")):
                drops = []
                for k in range(permute.SHUFFLES):
                    drawn = sorted(fold, key=lambda r: hashlib.md5(f"{permute.SEED}:{f}:{k}:{s}:{r[2]}".encode()).hexdigest())  # noqa: B023, S324
                    mixed = [((d[4], r[5]) if f == 0 else (r[4], d[5]), r[3]) for r, d in zip(fold, drawn, strict=True)]
                    score = lambda pairs: np.mean([np.mean([says(x) == y for x, y in pairs if y == c]) for c in (0, 1)])  # noqa: B023, E731
                    drops.append(score([(r[4:], r[3]) for r in fold]) - score(mixed))
                np.testing.assert_allclose(got[s, run, name], (np.mean(drops), np.std(drops)), atol=2e-6)
            assert got[s, run, "a"][0] > got[s, run, "c"][0]


def test_importance_broadcasts_no_exploded_rows(spark):
    """Rows of all folds and draws come from a few bars, so a plan that goes by these would broadcast them; folds are many tasks."""
    from marketjobs.jobs import pooled

    out = pooled.cell_importance(spark, "/root/testdata/sf0.001")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    tree = [(len(line) - len(line.lstrip(" :+-")), line) for line in plan.split("\n")]
    for i, (deep, line) in enumerate(tree):
        if "BroadcastExchange" in line:
            below = [x for d, x in tree[i + 1 : next((k for k in range(i + 1, len(tree)) if tree[k][0] <= deep), len(tree))]]
            assert not any("inline(" in x for x in below)
    numbered = f", {permute.TASKS * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM"
    assert numbered in plan


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quantiles_are_exact(spark, accuracy):
    """Small sketches, so that ranks are counted inside of brackets; ties, nulls, one value, a null key."""
    fractions = [0.0, 0.003, 0.1, 0.5, 0.77, 1.0]
    groups = {"normal": RNG.standard_normal(5000), "ties": RNG.integers(0, 7, 3000).astype(float), "one": np.array([4.0]), None: np.arange(11.0), "same": np.full(500, 2.5)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("ties", None), ("none", None)]
    got = {r["k"]: (r["n"], r["quantiles"]) for r in quantiles(spark.createDataFrame(rows, "k string, x double").repartition(4), ["k"], "x", fractions, accuracy).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k][0] == len(v)
        np.testing.assert_allclose(got[k][1], np.quantile(v, fractions), rtol=1e-12)
    assert quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", [0.5]).isEmpty()


def test_slices_are_many_tasks(spark):
    rows = spark.range(5).selectExpr("cast(id as string) as symbol").crossJoin(spark.range(12).selectExpr("id as slice"))
    seen = fit.dealt(rows).applyInPandas(lambda g: g, "symbol string, slice long").select(F.spark_partition_id().alias("p")).distinct().count()
    assert seen >= 2 * spark.sparkContext.defaultParallelism
