"""Permutation importance as joins: within a fold, the row at place i in one order takes a feature's value from the row at place i in another.

Rows meet by a grouping by place, behind one numbered exchange by fold. A join's sides would be taken for as small as the bars they are
exploded from, some 600 times fewer rows, and be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import rnd

ROWS, SHUFFLES, SEED = 242, 5, 42
#: Tasks a core: folds are few bytes of much work, which adaptive execution would put into one task.
TASKS = 4


def importance(folded: DataFrame, features: list[str], keys: tuple[str, ...] = ("symbol",), shuffles: int = SHUFFLES, seed: int = SEED) -> DataFrame:
    """keys, run, feature, pi_mean, pi_std: loss of balanced accuracy when a feature is shuffled within a fold.

    folded: keys, run, rn (order of rows), label and small whole-numbered features, of train rows. The model is the rate of ups by cell of all features.
    A shuffle of a feature is drawn once per row, as a digest of (seed, feature, shuffle, row), and orders the rows of each fold that the row is in,
    so it does not depend on partitions or on the run of the job.
    """
    fold = [*keys, "run"]
    folded = folded.repartition(TASKS * folded.sparkSession.sparkContext.defaultParallelism, *fold)
    cells = folded.groupBy(*fold, *features).agg(F.count("*").alias("seen"), F.sum("label").alias("ups"))
    up = cells.select(*fold, *features, ((F.col("ups") + 1) * 2 >= F.col("seen") + 2).cast("int").alias("says"))
    draws = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.lit(s).alias("s")) for i in range(len(features)) for s in range(shuffles)]))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("f").cast("string"), F.col("s").cast("string"), *keys, F.col("rn").cast("string"))
    own = reduce(lambda a, k: a.when(F.col("f") == k, F.col(features[k])), range(len(features)), F.when(F.lit(False), 0))
    drawn = folded.select(*fold, "rn", "label", *features, draws).withColumn("draw", F.md5(name)).withColumn("own", own)
    of = W.partitionBy(*fold, "f", "s")
    drawn = drawn.withColumn("i", F.row_number().over(of.orderBy("rn"))).withColumn("j", F.row_number().over(of.orderBy("draw", "rn")))
    takes = F.struct(F.col("i").alias("place"), F.struct("label", *features).alias("row"), F.lit(None).alias("other"))
    gives = F.struct(F.col("j").alias("place"), F.lit(None).alias("row"), F.col("own").alias("other"))
    placed = drawn.select(*fold, "f", "s", F.inline(F.array(takes, gives))).groupBy(*fold, "f", "s", "place").agg(F.max("row").alias("row"), F.max("other").alias("other"))
    mixed = placed.select(*fold, "f", "s", "row.label", *[F.when(F.col("f") == k, F.col("other")).otherwise(F.col(f"row.{c}")).alias(c) for k, c in enumerate(features)])
    # Shuffled rows are counted by cell before the model is asked; a cell that no train row has says up, as both rates are one half then.
    counted = mixed.groupBy(*fold, "f", "s", *features).agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    after = balanced(counted.join(up, [*fold, *features], "left"), [*fold, "f", "s"])
    before = balanced(cells.select(*fold, *features, F.col("seen").alias("n"), F.col("ups").alias("ones")).join(up, [*fold, *features]), fold)
    drops = after.join(before.withColumnRenamed("score", "base"), fold).withColumn("drop", F.col("base") - F.col("score"))
    mean = F.sum("drop") / shuffles
    out = drops.groupBy(*fold, "f").agg(F.sum(F.col("drop") * F.col("drop")).alias("q"), mean.alias("m"))
    spread = rnd(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / shuffles - F.col("m") * F.col("m"))), 6)
    feature = F.element_at(F.lit(features), F.col("f") + 1)
    return out.select(*fold, feature.alias("feature"), rnd(F.col("m"), 6).alias("pi_mean"), spread.alias("pi_std"))


def balanced(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score: mean share of right rows of the classes that occur. counted: n rows, `ones` of them up, and what the model says."""
    says = F.coalesce("says", F.lit(1))
    hits = counted.groupBy(*keys).agg(F.sum("ones").alias("p"), F.sum(F.col("n") - F.col("ones")).alias("q"), F.sum(F.when(says == 1, F.col("ones")).otherwise(0)).alias("hp"), F.sum(F.when(says == 0, F.col("n") - F.col("ones")).otherwise(0)).alias("hq"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    classes = (F.col("p") > 0).cast("int") + (F.col("q") > 0).cast("int")
    return hits.select(*keys, ((share("hp", "p") + share("hq", "q")) / classes).alias("score"))
