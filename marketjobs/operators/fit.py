"""Fitting and scoring per fold, and permutation importance.

Neighbouring folds share almost all their rows, so a group is a slice of a symbol's folds: its rows come once, as one matrix, and its folds
are cuts of it. A slice is a bounded window of rows, and a long symbol is many slices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import Folds

ROUNDS, RATE, CUTS, SHUFFLES = 300, 0.1, 8, 10
#: Tasks for each core of the session, so that the slices are even.
TASKS = 4


def boosted_stumps(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Logistic boosting of one-split trees on quantile cuts; missing values go left. Returns probabilities of 1."""
    x = np.where(np.isfinite(x), x, -np.inf)
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    score = np.full(len(y), np.log(base / (1 - base)))
    known = [x[np.isfinite(x[:, j]), j] for j in range(x.shape[1])]  # a column without a value has no cuts
    splits = [(j, c) for j, own in enumerate(known) if len(own) for c in np.unique(np.quantile(own, np.linspace(0.1, 0.9, CUTS)))]
    right = np.array([x[:, j] > c for j, c in splits], float)
    leaves = np.zeros((len(splits), 2))  # trees with the same cut add up
    for _ in range(ROUNDS if len(splits) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        gr, hr = right @ g, right @ h
        gain = gr**2 / (hr + 1) + (g.sum() - gr) ** 2 / (h.sum() - hr + 1)
        k = int(np.argmax(gain))
        a, b = (g.sum() - gr[k]) / (h.sum() - hr[k] + 1) * RATE, gr[k] / (hr[k] + 1) * RATE
        leaves[k] += a, b
        score = score + np.where(right[k] > 0, b, a)

    def predict(z: np.ndarray) -> np.ndarray:
        z = np.where(np.isfinite(z), z, -np.inf)
        out = np.full(len(z), np.log(base / (1 - base)))
        for (j, c), (a, b) in zip(splits, leaves, strict=True):
            out = out + np.where(z[:, j] > c, b, a)
        return 1 / (1 + np.exp(-out))

    return predict


def runs_of(rows: pd.DataFrame, f: Folds, features: list[str]):
    """(run, train, test) of the folds of a slice: cuts of one matrix in order of date. Rows are numbered backwards from the newest, 0."""
    rows = rows.sort_values("rn")
    back, x, y = (rows["n"] - rows["rn"]).to_numpy(), rows[features].to_numpy(float), rows["label"].to_numpy(float)
    n, first = int(rows["n"].iloc[0]), int(rows["slice"].iloc[0]) * f.per_slice
    at = lambda b: int(np.searchsorted(-back, -b))
    for run in range(first, min(first + f.per_slice, f.last_run(n) + 1)):
        end = run * f.step
        old = end + f.test + f.purge
        train, test = slice(at(old + f.train - 1), at(old) + 1), slice(at(end + f.test - 1), at(end) + 1)
        yield run, (x[train], y[train]), (x[test], rows.iloc[test])


def dealt(sliced: DataFrame):
    """Groups of slices, a numbered exchange: few bytes and much work, which adaptive execution would put into one task."""
    return sliced.repartition(TASKS * sliced.sparkSession.sparkContext.defaultParallelism, "symbol", "slice").groupBy("symbol", "slice")


def walk_forward(sliced: DataFrame, features: list[str], f: Folds, fitter=boosted_stumps) -> DataFrame:
    """sliced rows (symbol, slice, date, rn, n, label, features) -> the test rows of all folds with their probability."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, (x, y), (z, test) in runs_of(rows, f, features):
            out.append(pd.DataFrame({"symbol": test["symbol"], "run": k, "date": test["date"], "label": test["label"], "pred": fitter(x, y)(z), "train_n": len(y)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["symbol", "run", "date", "label", "pred", "train_n"])

    return dealt(sliced).applyInPandas(run, "symbol string, run long, date date, label int, pred double, train_n int")


def balanced_accuracy(y: np.ndarray, p: np.ndarray) -> float:
    hit = [(p[y == c] >= 0.5).mean() if c else (p[y == c] < 0.5).mean() for c in (0, 1) if (y == c).any()]
    return float(np.mean(hit)) if hit else 0.0


def importance(sliced: DataFrame, features: list[str], f: Folds, rows_used: int = 242, shuffles: int = SHUFFLES, fitter=boosted_stumps) -> DataFrame:
    """Mean and deviation of the loss of balanced accuracy when a feature is shuffled, on a fold's newest train rows; the seed comes from the run.

    All shuffles of a fold are predicted as one block.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, (x, y), _ in runs_of(rows, f, features):
            x, y = x[-rows_used:], y[-rows_used:]
            model, rng = fitter(x, y), np.random.default_rng(42 + k)
            block = np.tile(x, (len(features) * shuffles, 1, 1))
            for j in range(len(features)):
                for z in block[j * shuffles : (j + 1) * shuffles]:
                    z[:, j] = rng.permutation(z[:, j])
            base = balanced_accuracy(y, model(x))
            drops = np.array([base - balanced_accuracy(y, p) for p in model(block.reshape(-1, len(features))).reshape(-1, len(y))]).reshape(len(features), shuffles)
            out += [(rows["symbol"].iloc[0], k, name, float(d.mean()), float(d.std())) for name, d in zip(features, drops, strict=True)]
        return pd.DataFrame(out, columns=["symbol", "run", "feature", "pi_mean", "pi_std"])

    return dealt(sliced).applyInPandas(run, "symbol string, run long, feature string, pi_mean double, pi_std double")


def chosen_features(pi: DataFrame, limit: float = 0.03, least: int = 2, keys=("symbol", "run")) -> DataFrame:
    """Per fold: all features above the limit, or else the best `least`."""
    fold = W.partitionBy(*keys)
    rows = pi.withColumn("good", F.count_if(F.col("pi_mean") > limit).over(fold)).withColumn("rank", F.row_number().over(fold.orderBy(F.col("pi_mean").desc(), "feature")))
    return rows.where((F.col("pi_mean") > limit) | (F.col("good") < least) & (F.col("rank") <= least)).drop("good")


def rollup(pi: DataFrame, *keys: str) -> DataFrame:
    return pi.groupBy(*keys, "feature").agg(F.sum("pi_mean").alias("pi_sum"), F.count("*").alias("n"), F.avg("pi_mean").alias("pi_avg")).orderBy(*keys, F.col("pi_sum").desc(), "feature")
