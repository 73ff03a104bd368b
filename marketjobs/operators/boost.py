"""Histogram gradient boosting as aggregates: the trees of all folds grow together, a level at a time.

Features are binned, and a tree knows rows by their bins only, so the rows of a fold with equal bins are one cell with counts. Per
level, gradients are added up by (fold, node, feature, bin), a running sum over bins gives the gain of every split, and the best one of
each node is joined back to the cells. No fold is collected, whatever its number of rows: models may be pooled over all symbols.

Gradients are whole numbers of 2^-20, so sums do not depend on the order of rows, and a run again grows the same trees. Test rows
are cells without weight that follow the splits, so nothing is predicted afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..sources.shared import written

BINS, DEPTH, ROUNDS, RATE, RIDGE = 8, 2, 10, 0.3, 1.0
#: Gradients are multiples of one over this.
ONE = 1 << 20


def with_bins(rows: DataFrame, features: list[str], first: Column, bins: int = BINS) -> DataFrame:
    """rows with b0, b1, ...: the bin of each feature; missing values are in the lowest one.

    Cuts are quantiles over the rows of `first`, which should be older than any row to be scored, so that nothing is known ahead.
    """
    fractions = [i / bins for i in range(1, bins)]
    old = rows.where(first)
    long = old.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(features)])))
    cuts = quantiles(long, ["f"], "x", fractions).agg(F.map_from_entries(F.collect_list(F.struct("f", "quantiles"))).alias("cuts"))
    rows = rows.crossJoin(F.broadcast(cuts))  # one row of len(features) * bins numbers
    bin_of = lambda i, c: F.coalesce(F.size(F.filter(F.try_element_at("cuts", F.lit(i)), lambda e: e < F.col(c))), F.lit(0))
    return rows.select(*[c for c in rows.columns if c != "cuts"], *[F.greatest(bin_of(i, c), F.lit(0)).cast("int").alias(f"b{i}") for i, c in enumerate(features)])


def cells_of(folded: DataFrame, n_features: int) -> DataFrame:
    """(run, b.., n, ups, score): cells of all rows of a fold; n and ups count train rows; scores start at the fold's log odds."""
    bins, train = [f"b{i}" for i in range(n_features)], F.col("part") == "train"
    cells = folded.groupBy("run", *bins).agg(F.count_if(train).alias("n"), F.coalesce(F.sum(F.when(train, F.col("label"))), F.lit(0)).cast("long").alias("ups"))
    base = cells.groupBy("run").agg(F.sum("n").alias("all"), F.sum("ups").alias("up"))
    odds = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("up").cast("double") / F.col("all").cast("double")))
    base = base.where("all > 0").select("run", F.log(odds / (1 - odds)).alias("score"))
    return cells.join(base, "run")


def gradients(cells: DataFrame) -> DataFrame:
    """cells with g and h: sums of first and second derivatives of a cell's train rows, in steps of 1 / ONE."""
    p = 1 / (1 + F.exp(-F.col("score")))
    steps = lambda x: F.floor(x * ONE + 0.5).cast("long")
    return cells.withColumn("g", steps(F.col("ups") - F.col("n") * p)).withColumn("h", steps(F.col("n") * p * (1 - p)))


def splits(cells: DataFrame, n_features: int) -> DataFrame:
    """(run, node, f, cut, gain): the best split of each node, bins up to cut to the left; ties go to the first feature and cut. Nodes without a gain have none."""
    bins = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("bin")) for i in range(n_features)]))
    hist = cells.select("run", "node", "n", "g", "h", bins).groupBy("run", "node", "f", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")])
    own = W.partitionBy("run", "node", "f")  # as many rows as there are bins
    left, whole = own.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    hist = hist.select("run", "node", "f", F.col("bin").alias("cut"), *[F.sum(c).over(left).alias(f"{c}l") for c in ("n", "g", "h")], *[F.sum(c).over(whole).alias(f"{c}t") for c in ("n", "g", "h")])
    term = lambda g, h: (g / ONE) * (g / ONE) / (h / ONE + RIDGE)
    c = {k: F.col(k) for k in ("nl", "gl", "hl", "nt", "gt", "ht")}
    gain = term(c["gl"], c["hl"]) + term(c["gt"] - c["gl"], c["ht"] - c["hl"]) - term(c["gt"], c["ht"])
    # Gains are compared in steps of 1e-9, as engines may differ in the last bit of equal ones.
    hist = hist.withColumn("gain", F.floor(gain * 1e9 + 0.5).cast("long")).where("nl > 0 and nl < nt and gain > 0")
    best = hist.groupBy("run", "node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("cut")).alias("cut"))).alias("best"))
    return best.select("run", "node", (-F.col("best.f")).alias("f"), (-F.col("best.cut")).alias("cut"), F.col("best.gain").alias("gain"))


def descended(cells: DataFrame, found: DataFrame, n_features: int) -> DataFrame:
    """cells at the children of their nodes: 2 * node, or 2 * node + 1 right of the cut; without a split all are left."""
    value = reduce(lambda a, i: a.when(F.col("f") == i, F.col(f"b{i}")), range(n_features), F.when(F.lit(False), 0))
    right = F.coalesce((value > F.col("cut")).cast("int"), F.lit(0))
    out = cells.join(found.select("run", "node", "f", "cut"), ["run", "node"], "left")
    return out.withColumn("node", 2 * F.col("node") + right).drop("f", "cut")


def leaf_values(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """(run, node, value, n)"""
    sums = cells.groupBy("run", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    return sums.select("run", "node", (F.col("g") / ONE / (F.col("h") / ONE + RIDGE) * rate).alias("value"), "n")


def grown(cells: DataFrame, n_features: int, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """cells at the leaves of the next tree of each fold, and the splits of each level."""
    cells, levels = gradients(cells).withColumn("node", F.lit(1)), []
    for _ in range(depth):
        levels.append(splits(cells, n_features))
        cells = descended(cells, levels[-1], n_features)
    return cells, levels


def boosted(cells: DataFrame, n_features: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> DataFrame:
    """cells with the score after so many rounds; each is written, so a lost executor costs a part of one round."""
    for _ in range(rounds):
        at, _ = grown(cells, n_features, depth)
        out = at.join(leaf_values(at, rate), ["run", "node"]).withColumn("score", F.col("score") + F.col("value"))
        cells = written(out.select("run", *[f"b{i}" for i in range(n_features)], F.col("ups"), "score", at["n"].alias("n")), "boost")
    return cells


def walk_forward(folded: DataFrame, n_features: int, **how: float) -> DataFrame:
    """folded rows (symbol, date, run, part, label, b..) -> test rows with their probability; one model per run, over all symbols."""
    bins = [f"b{i}" for i in range(n_features)]
    scored = boosted(written(cells_of(folded, n_features), "boost"), n_features, **how)
    test = folded.where("part = 'test'").join(scored.select("run", *bins, "score"), ["run", *bins])
    return test.select("symbol", "date", "run", "label", (1 / (1 + F.exp(-F.col("score")))).alias("pred"))
