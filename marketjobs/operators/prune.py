"""Feature sets by name, correlations of features, and pruning by them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import rnd

BATCH = 200
#: Columns of a block of correlations_wide: a task holds seven matrices of this width.
BLOCK = 1000
#: Rows whose means the values are taken from before they are multiplied; any other point gives the same results but for rounding.
CENTRE_ROWS = 1000


def resolve_sets(sets: DataFrame, catalog: DataFrame) -> DataFrame:
    """name (parts joined by -) -> its columns in order of first appearance, each once. A part without columns raises."""
    parts = sets.select("name", F.posexplode(F.split("name", "-")).alias("part_pos", "set_name"))
    joined = parts.join(catalog, "set_name", "left")
    missing = F.when(F.col("col_name").isNull(), F.raise_error(F.concat(F.lit("unknown feature set: "), F.col("set_name"))).cast("string")).otherwise(F.col("col_name"))
    first = joined.withColumn("col_name", missing).groupBy("name", "col_name").agg(F.min(F.struct("part_pos", "pos")).alias("p"))
    return first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "col_name"))), lambda x: x["col_name"]).alias("cols"))


def resolved(catalog: DataFrame) -> DataFrame:
    """set_name, pos, col_name of single sets, through resolve_sets."""
    one = resolve_sets(catalog.select(F.col("set_name").alias("name")).distinct(), catalog)
    return one.select(F.col("name").alias("set_name"), F.posexplode("cols").alias("pos", "col_name"))


def set_pairs(catalog: DataFrame) -> DataFrame:
    """All unordered pairs of set names."""
    names = catalog.select("set_name").distinct()
    return names.alias("a").join(names.alias("b"), F.col("a.set_name") < F.col("b.set_name")).select(F.concat_ws("-", "a.set_name", "b.set_name").alias("name"))


def normalized(names: DataFrame, column: str = "name") -> DataFrame:
    """Set names without brackets, quotes and spaces, separators as -."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(column), r"[\[\]'\"\s]", ""), r"[,_]+", "-")
    return names.withColumn("clean", clean)


def split_sizes(rows: DataFrame, column: str = "pi_size") -> DataFrame:
    """A packed size of the importance window, such as 1.5-r, as the number and the handling: -r is separately, nothing is together."""
    packed = F.col(column)
    handling = F.when(packed.endswith("-r"), "separately").when(packed.rlike(r"^[0-9.]+$"), "together")
    return rows.withColumn("pi_handling", handling).withColumn("pi_size", F.regexp_replace(packed, "-r$", "").try_cast("double"))


def correlations(rows: DataFrame, columns: list[str], batch: int = BATCH) -> DataFrame:
    """(a, b, i, j, r) for i < j: pairwise complete correlations, a batch of expressions per pass over the rows."""
    pairs = [(i, j, a, b) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
    out = None
    for k in range(0, len(pairs), batch):
        part = rows.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.corr(a, b).alias("r")) for i, j, a, b in pairs[k : k + batch]]).alias("x"))
        part = part.select(F.inline("x"))
        out = part if out is None else out.unionByName(part)
    return out


def correlations_wide(rows: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """(a, b, i, j, r) for i < j, for very many columns: pairwise complete correlations from block Gram matrices.

    A task adds up, for all pairs of columns at once, the products of its rows where both are there, and gives a row per pair; these are
    summed by pair. One pass over the rows for up to `block` columns, and one for each pair of blocks beyond. Null, NaN and infinite
    values are missing; r is null for fewer than two rows or a column without spread.
    """
    types = [F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
    numbers, centre = rows.select(*types), np.zeros(len(columns))
    some = numbers.limit(CENTRE_ROWS).agg(*[F.avg(F.when(F.abs(c) < float("inf"), F.col(c))).alias(c) for c in numbers.columns]).first()
    centre = np.array([x or 0.0 for x in some])
    cuts = [range(k, min(k + block, len(columns))) for k in range(0, len(columns), block)]
    out = None
    for left, right in combinations_with_replacement(cuts, 2):
        part = gram(numbers, left, right, centre)
        out = part if out is None else out.unionByName(part)
    names = F.array(*map(F.lit, columns))
    sx, sy, n = F.col("sx"), F.col("sy"), F.col("n")
    spread = lambda s, q: F.greatest(F.col(q) - F.col(s) * F.col(s) / n, F.lit(0.0))
    flat = lambda s, q: spread(s, q) <= F.col(q) * 1e-13
    r = (F.col("sxy") - sx * sy / n) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    r = F.when((n >= 2) & ~flat("sx", "sxx") & ~flat("sy", "syy"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return out.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "i", "j", r.alias("r"))


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def gram(numbers: DataFrame, left: range, right: range, centre: np.ndarray) -> DataFrame:
    """i, j and SUMS over the rows that have both, for i < j of two blocks of the columns c0, c1, and so on."""
    used = sorted({*left, *right})
    x_at, y_at = ([used.index(k) for k in cut] for cut in (left, right))
    mine, shift = np.array(list(left)), centre[used]
    i, j = np.meshgrid(mine, np.array(list(right)), indexing="ij")
    upper = i < j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), len(left), len(right)))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - shift
            there = np.isfinite(values)
            values[~there] = 0.0
            there = there.astype(float)
            x, y, in_x, in_y = values[:, x_at], values[:, y_at], there[:, x_at], there[:, y_at]
            for k, (p, q) in enumerate(((in_x, in_y), (x, in_y), (in_x, y), (x * x, in_y), (in_x, y * y), (x, y))):
                total[k] += p.T @ q
        if total[0].any():
            yield pa.record_batch([pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32()), *[pa.array(t[upper]) for t in total]], names=["i", "j", *SUMS])

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    sums = numbers.select(*[f"c{k}" for k in used]).mapInArrow(run, schema)
    return sums.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def pruned(corr: DataFrame, limit: float) -> DataFrame:
    """Columns that an earlier column, itself dropped or not, correlates with above the limit."""
    return corr.where(F.abs("r") > limit).select(F.col("b").alias("dropped")).distinct()


def representatives(corr: DataFrame, target: DataFrame, limit: float) -> DataFrame:
    """Of each cluster of correlated columns, in column order, the one closest to the target. One row per column or pair of columns goes in.

    A column that no earlier cluster has used opens a cluster of all columns it correlates with, used ones too; the first of equals stands for it.
    """
    both = corr.where(F.abs("r") > limit).select("a", "b")
    links = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(target.select(F.col("col").alias("a"), F.col("col").alias("b")))
    score = target.select(F.col("col").alias("b"), F.coalesce(F.abs("r"), F.lit(0.0)).alias("score"), (-F.col("pos")).alias("back"))
    clusters = links.join(score, "b").groupBy("a").agg(F.collect_set("b").alias("members"), F.max_by("b", F.struct("score", "back")).alias("best"))
    listed = clusters.join(target.select(F.col("col").alias("a"), "pos"), "a").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "members", "best"))).alias("all"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("used"), none.alias("out"))
    step = lambda s, x: F.when(F.array_contains(s["used"], x["a"]), s).otherwise(F.struct(F.array_union(s["used"], x["members"]).alias("used"), F.array_union(s["out"], F.array(x["best"])).alias("out")))
    return listed.select(F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("col"))


def target_corr(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    one = rows.agg(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(i).alias("pos"), F.corr(c, target).alias("r")) for i, c in enumerate(columns)]).alias("x"))
    return one.select(F.inline("x")).withColumn("r", rnd(F.col("r"), 9))
