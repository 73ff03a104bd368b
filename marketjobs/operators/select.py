"""Choosing configurations, keeping their predictions, and ensembles of them. Tables of configurations are small: a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import div, rnd
from .metrics import KEYS


def top(rows: DataFrame, k: int, by: str, *order: str, keys=KEYS) -> DataFrame:
    """The first k rows of each group by falling order, nulls last; ties in order of the keys."""
    w = W.partitionBy(by).orderBy(*[F.col(c).desc_nulls_last() for c in order], *[F.col(c) for c in keys])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_set(metrics: DataFrame, k: int) -> DataFrame:
    """The best configuration of each feature set, then the k best of each horizon."""
    w = W.partitionBy("horizon", "features").orderBy(F.col("composite").desc_nulls_last(), *KEYS)
    return top(metrics.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r"), k, "horizon", "composite")


def with_edges(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("pos_edge", rnd(F.col("pprec") - F.col("pos_rate"), 2)).withColumn("neg_edge", rnd(F.col("nprec") - (F.lit(1.0) - F.col("pos_rate")), 2))


def edge_select(metrics: DataFrame, edge: float, most: int, least: int) -> DataFrame:
    """Per horizon the first `most` configurations with both edges above `edge`; where they are fewer than `least`, the best of each feature set instead."""
    both = (F.col("pos_edge") > edge) & (F.col("neg_edge") > edge)
    rows = with_edges(metrics).withColumn("qualified", F.coalesce(F.count_if(both).over(W.partitionBy("horizon")), F.lit(0)))
    chosen = top(rows.where(both & (F.col("qualified") >= least)), most, "horizon", "composite")
    return chosen.unionByName(best_per_set(rows.where(F.col("qualified") < least), least))


def of_selected(pred: DataFrame, chosen: DataFrame, keys=KEYS) -> DataFrame:
    """The predictions of the chosen configurations. Spark broadcasts them where their size allows."""
    return pred.join(chosen.select(*keys).distinct(), list(keys), "left_semi")


def pending_days(history: DataFrame, labels: DataFrame, least: int = 2, keys=KEYS) -> DataFrame:
    """Configurations with their last as-of date and the labelled days after it, if more than `least`.

    The days after each date are one running count per horizon over distinct dates; a configuration looks up its last date.
    labels has the dates of the history, labelled or not.
    """
    last = history.groupBy(*keys).agg(F.max("date").alias("last_date"))
    days = labels.groupBy("horizon", F.col("date").alias("last_date")).agg(F.max(F.col("label").isNotNull().cast("long")).alias("known"))
    after = W.partitionBy("horizon").orderBy(F.col("last_date").desc()).rowsBetween(W.unboundedPreceding, -1)
    counted = days.select("horizon", "last_date", F.coalesce(F.sum("known").over(after), F.lit(0)).alias("pending"))
    return last.join(counted, ["horizon", "last_date"]).where(F.col("pending") > least).select(*keys, "last_date", "pending")


def edge_of(pred: Column) -> Column:
    """Edge of a prediction: at 0.45 and above it counts as up. In hundredths, so that edges add up exactly."""
    up = F.col("pprec") - F.col("pos_rate")
    down = -F.col("nprec") + (F.lit(1.0) - F.col("pos_rate"))
    shifted = F.when(pred < 0.45, pred - 1).otherwise(pred)
    return F.rint(F.when(shifted > 0, up).otherwise(down) * 100).cast("long")


def ensemble(pred: DataFrame, metrics: DataFrame, n: int = 1, keys=KEYS) -> DataFrame:
    """By symbol, horizon and date: summed edges of the configurations, the ensemble's prediction, and the place of the date."""
    rows = pred.join(metrics.select(*keys, "pos_rate", "pprec", "nprec").distinct(), list(keys)).withColumn("edge", edge_of(F.col("pred")))
    out = rows.groupBy("symbol", "horizon", "date").agg(F.sum("edge").alias("e"))
    out = out.withColumn("ensemble_edge", F.col("e") / 100.0).withColumn("ensemble_pred", rnd(F.col("e") / 100.0 / n + 0.5, 2))
    return out.withColumn("days_to_exp", F.row_number().over(W.partitionBy("symbol", "horizon").orderBy("date"))).drop("e")


def ensemble_precision(ens: DataFrame, labels: DataFrame) -> DataFrame:
    """By horizon: how often ensemble predictions outside 0.48..0.52 were right, for ups and downs."""
    rows = ens.join(labels.where("label is not null"), ["symbol", "horizon", "date"])
    up, down = F.col("ensemble_pred") > 0.52, F.col("ensemble_pred") < 0.48
    share = lambda c, y: rnd(F.avg(F.when(c, (F.col("label") == y).cast("double"))), 3)
    return rows.where(up | down).groupBy("horizon").agg(share(up, 1).alias("pos_prec"), share(down, 0).alias("neg_prec"), F.count("*").alias("n"))


def price_ratio(pred: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions of dates with the close of the date and the symbol's last close over it."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"))
    days = pred.select("symbol", "horizon", "date").distinct()
    rows = days.join(bars.select("symbol", "date", F.col("close").alias("predicted_price")), ["symbol", "date"]).join(last, "symbol")
    return rows.withColumn("ratio", rnd(div(F.col("last_close"), F.col("predicted_price")) - 1, 6))


def deduplicated(history: DataFrame, keys=(*KEYS, "symbol", "date")) -> DataFrame:
    """One row per key: the one of the latest run; of several, the least by pred and then by the other columns in order."""
    others = [c for c in history.columns if c not in (*keys, "run", "pred")]
    w = W.partitionBy(*keys).orderBy(F.col("run").desc(), "pred", *others)
    return history.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def merged(old: DataFrame, new: DataFrame, horizon: int) -> DataFrame:
    """Two histories, each without its exact duplicates, the new one cut to a horizon."""
    return old.dropDuplicates().unionByName(new.where(F.col("horizon") == horizon).dropDuplicates(), allowMissingColumns=True)
