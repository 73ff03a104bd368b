"""Exact quantiles of groups of any size: a mergeable sketch brackets each, and only rows inside a bracket are counted value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The sketch is off by at most a share of 1 / ACCURACY of a group's rows, so a bracket holds some four such shares.
ACCURACY = 1000


def quantiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """keys, n, quantiles: per group the values at the fractions, with linear interpolation between ranks; missing values do not count.

    No task holds a group's values: the sketch has a bounded buffer, counts below the brackets are partly aggregated, and the
    window over a bracket has its distinct values only. A rank outside of its bracket would be an error, not a wrong value.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    slack, n = 2.0 / accuracy, len(fractions)
    at = lambda ps: F.percentile_approx("__v", F.lit(ps), F.lit(accuracy))
    lo, hi = [max(0.0, p - slack) for p in fractions], [min(1.0, p + slack) for p in fractions]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), at(lo).alias("lo"), at(hi).alias("hi"))
    few = F.col("n") <= 4 * accuracy  # a whole group is then as few rows as a bracket may have
    ends = [F.when(few | F.lit(p == 0), F.col("least")).otherwise(F.col("lo")[i]) for i, p in enumerate(lo)], [F.when(few | F.lit(p == 1), F.col("most")).otherwise(F.col("hi")[i]) for i, p in enumerate(hi)]
    sketch = sketch.select(*keys, "n", F.array(*ends[0]).alias("lo"), F.array(*ends[1]).alias("hi"))
    named = sketch.select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "lo", "hi")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = rows.join(named, same) if keys else rows.crossJoin(F.broadcast(named))
    below = joined.groupBy(*keys).agg(F.array(*[F.count_if(F.col("__v") < F.col("lo")[i]) for i in range(n)]).alias("below"))
    hit = F.array_compact(F.array(*[F.when((F.col("__v") >= F.col("lo")[i]) & (F.col("__v") <= F.col("hi")[i]), i) for i in range(n)]))
    counts = joined.select(*keys, "n", "__v", F.explode(hit).alias("i")).groupBy(*keys, "i", "__v").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    below = below.select(*[F.col(k).alias(f"__{k}") for k in keys], "below")
    counts = counts.join(below, same) if keys else counts.crossJoin(F.broadcast(below))
    end = F.element_at("below", F.col("i") + 1) + F.sum("c").over(W.partitionBy(*keys, "i").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("end", end).withColumn("rank", (F.col("n") - 1) * F.element_at(F.lit([float(p) for p in fractions]), F.col("i") + 1))
    holds = lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("c"))
    pick = lambda r: F.max(F.when(holds(r), F.col("__v")))
    found = ranked.groupBy(*keys, "i").agg(F.first("n").alias("n"), F.first("rank").alias("rank"), pick(F.floor("rank")).alias("a"), pick(F.ceil("rank")).alias("b"))
    missed = F.raise_error(F.lit("a rank is outside of its bracket")).cast("double")
    whole = F.when(F.col("a").isNull() | F.col("b").isNull(), missed).when(F.col("a") == F.col("b"), F.col("a"))
    x = whole.otherwise((F.ceil("rank") - F.col("rank")) * F.col("a") + (F.col("rank") - F.floor("rank")) * F.col("b"))
    out = found.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", x.alias("x")))).alias("q"))
    return out.select(*keys, "n", F.transform("q", lambda q: q["x"]).alias("quantiles"))
