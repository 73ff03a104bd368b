"""Walk-forward folds: planned by arithmetic on row numbers, joined to rows without a range join, and scored by a relational model."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import rnd, series

DAYS_A_YEAR = 245


def numbered(rows: DataFrame) -> DataFrame:
    """rows (symbol, date, label) with known label, numbered from 1 by symbol; n: rows of the symbol."""
    known = rows.where("label is not null").withColumn("rn", F.row_number().over(series()))
    return known.withColumn("n", F.count("*").over(series().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def plan(sizes: DataFrame, years: int, runs: int | None, step: int, test: int, purge: int, days: int = DAYS_A_YEAR) -> DataFrame:
    """symbol, n -> a row per run that fits, or the newest `runs` of them: first and last row of test and train, both included; `purge` rows between them are left out."""
    train = days * years
    last = F.greatest(F.floor((F.col("n") - test - purge - train) / step).cast("int"), F.lit(0))
    last = last if runs is None else F.least(last, F.lit(runs - 1))
    out = sizes.select("symbol", F.col("n").cast("int").alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("run"))
    out = out.withColumn("test_end", F.col("n") - F.col("run") * step).withColumn("test_start", F.col("test_end") - test + 1)
    out = out.withColumn("train_end", F.col("test_start") - 1 - purge).withColumn("train_start", F.col("train_end") - train + 1)
    return out.where("train_start >= 1").select("symbol", "run", "train_start", "train_end", "test_start", "test_end")


def with_folds(rows: DataFrame, years: int, runs: int | None, step: int, test: int, purge: int, days: int = DAYS_A_YEAR) -> DataFrame:
    """numbered rows, once for each run they are part of, with part `train` or `test`; without `runs`, all that fit the symbol's rows.

    Runs are equidistant, so those that a row belongs to are a range of whole numbers, computed and exploded; nothing is joined.
    """
    train, back = days * years, F.col("n") - F.col("rn")  # rows after this one
    last_run = F.floor((F.col("n") - test - purge - train) / step)

    def span(first_back: int, length: int):
        lo = F.ceil((back - (first_back + length - 1)) / step)
        hi = F.floor((back - first_back) / step)
        return F.greatest(lo, F.lit(0)), F.least(hi, last_run, *([] if runs is None else [F.lit(runs - 1)]))

    parts = []
    for name, first, length in (("test", 0, test), ("train", test + purge, train)):
        lo, hi = span(first, length)
        parts.append(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")).alias(name))
    out = rows.select("*", *parts)
    test_rows = out.select(*rows.columns, F.explode("test").alias("run"), F.lit("test").alias("part"))
    return test_rows.unionByName(out.select(*rows.columns, F.explode("train").alias("run"), F.lit("train").alias("part")))


@dataclass(frozen=True)
class Folds:
    """Equidistant folds of a series, counted from its newest row back; per_slice of them are fitted together."""

    train: int
    test: int
    step: int
    purge: int
    runs: int | None = None
    per_slice: int = 16

    def last_run(self, n: int) -> int:
        last = (n - self.test - self.purge - self.train) // self.step
        return last if self.runs is None else min(last, self.runs - 1)


def with_slices(rows: DataFrame, f: Folds) -> DataFrame:
    """numbered rows, once for each slice of folds that needs them."""
    back, wide = F.col("n") - F.col("rn"), f.per_slice * f.step
    reach = (f.per_slice - 1) * f.step + f.test + f.purge + f.train - 1
    last = F.floor((F.col("n") - f.test - f.purge - f.train) / f.step)
    last = F.floor((last if f.runs is None else F.least(last, F.lit(f.runs - 1))) / f.per_slice)
    lo, hi = F.greatest(F.ceil((back - reach) / wide), F.lit(0)), F.least(F.floor(back / wide), last)
    return rows.withColumn("slice", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))


def class_dist(folded: DataFrame, *keys: str) -> DataFrame:
    test = folded.where("part = 'test'")
    n = F.count("*")
    return test.groupBy(*keys, "run").agg(n.alias("test_n"), F.count_if(F.col("label") == 1).alias("pos_n"), F.count_if(F.col("label") == 0).alias("neg_n"), rnd(F.count_if(F.col("label") == 1) / n, 6).alias("pos_frac"))


def grid(spark: SparkSession, **choices: list) -> DataFrame:
    """All combinations of the choices; parameters only, a row each."""
    return spark.createDataFrame([dict(zip(choices, x, strict=True)) for x in product(*choices.values())]).select(*choices)


def rate_model(folded: DataFrame, feature: str, *keys: str) -> DataFrame:
    """Scores test rows by the share of ups among the fold's train rows in the same bucket of a feature (add-one), in hundredths."""
    train = folded.where("part = 'train'").groupBy(*keys, "run", feature).agg(F.count("*").alias("seen"), F.sum("label").alias("ups"))
    test = folded.where("part = 'test'").join(train, [*keys, "run", feature], "left")
    p = (F.coalesce("ups", F.lit(0)) + 1) / (F.coalesce("seen", F.lit(0)) + 2.0)
    return test.withColumn("pred", rnd(p, 6)).withColumn("acc", ((F.col("pred") >= 0.5).cast("int") == F.col("label")).cast("int"))
