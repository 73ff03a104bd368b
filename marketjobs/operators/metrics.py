"""Scoring of stored predictions: confident predictions, metrics by configuration, calibration, scores by streak."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.rolling import div, rnd

KEYS = ("horizon", "model", "train_years", "features", "pi_size", "pi_handling", "min_feats")
EPS = 1e-15


def lower_bound(th: float) -> Column:
    """1 - th as double arithmetic gives it: a probability of 0.45 is not below 1 - 0.55."""
    return F.lit(1.0 - th)


def confident(pred: DataFrame, th: float) -> DataFrame:
    return pred.where((F.col("pred") > th) | (F.col("pred") < lower_bound(th)))


def filtered(pred: DataFrame, horizons: Iterable[int], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The predictions of these horizons that the caller's filter keeps; it is given those of one horizon at a time, so it can go by their dates and scores."""
    parts = [keep(pred.where(F.col("horizon") == r)) for r in sorted(set(horizons))]
    if not parts:
        raise ValueError("no horizons")
    return reduce(DataFrame.unionByName, parts)


def three_way(p: Column, th: float) -> Column:
    """1, 0, or null for an undecided probability."""
    return F.when(p >= th, 1).when(p <= lower_bound(th), 0)


def clipped(p: Column, eps: float = EPS) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def on_grid(p: Column) -> Column:
    """To steps of 0.05."""
    return F.rint(F.rint(p / 0.05) * 0.05 * 100) / 100


def logistic(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


#: Sums that the metrics of any union of sets of predictions follow from.
COUNTS = ("records", "ups", "pos_preds", "neg_preds", "tp", "tn", "sure", "sure_pos", "sure_neg", "sure_tp", "sure_tn")
LOSSES = ("brier_sum", "loss_sum")


def metric_sums(pred: DataFrame, min_th: float = 0.55, cov_th: float = 0.75, keys=KEYS) -> DataFrame:
    """By key: COUNTS and LOSSES of the records of both known outcome and confident prediction; one shuffle, partly aggregated before."""
    rows = confident(pred.na.drop(subset=[*keys, "test_pos_n", "pred"]), min_th)
    p = clipped(F.col("pred"))
    rows = rows.withColumn("y", F.col("test_pos_n").cast("int")).withColumn("p", p).withColumn("yhat", three_way(F.col("p"), min_th)).where("yhat is not null")
    sure = (F.col("p") >= cov_th) | (F.col("p") <= lower_bound(cov_th))
    pos, neg, up, down = F.col("yhat") == 1, F.col("yhat") == 0, F.col("y") == 1, F.col("y") == 0
    n = lambda c: F.count_if(c)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("records"), n(up).alias("ups"), n(pos).alias("pos_preds"), n(neg).alias("neg_preds"), n(pos & up).alias("tp"), n(neg & down).alias("tn"),
        n(sure).alias("sure"), n(sure & pos).alias("sure_pos"), n(sure & neg).alias("sure_neg"), n(sure & pos & up).alias("sure_tp"), n(sure & neg & down).alias("sure_tn"),
        F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier_sum"), F.sum(F.when(up, -F.log("p")).otherwise(-F.log(1 - F.col("p")))).alias("loss_sum"),
    )


def config_metrics(pred: DataFrame, min_th: float = 0.55, cov_th: float = 0.75, keys=KEYS) -> DataFrame:
    """One row per configuration with records of both known outcome and confident prediction.

    brier and log_loss use clipped probabilities; log_loss needs both outcomes, mcc both outcomes and both predicted classes.
    """
    return from_sums(metric_sums(pred, min_th, cov_th, keys), keys)


def cutoff_metrics(pred: DataFrame, cutoffs: list[str], keys=KEYS) -> DataFrame:
    """config_metrics of the predictions since each of the cutoff dates: sums by the interval between cutoffs, then sums of all later intervals.

    Each prediction is read and counted once, however many cutoffs there are; only sums, a row per key and interval, are added up.
    """
    if not cutoffs:
        raise ValueError("no cutoff dates")
    dates = F.array(*[F.lit(c).cast("date") for c in sorted(set(cutoffs))])
    past = F.size(F.filter(dates, lambda c: c <= F.col("date")))
    sums = metric_sums(pred.withColumn("interval", past).where("interval > 0"), keys=("interval", *keys))
    every = sums.select(*keys).distinct().select(F.explode(F.sequence(F.lit(1), F.size(dates))).alias("interval"), *keys)
    none = every.select("interval", *keys, *[F.lit(0).cast("long").alias(c) for c in COUNTS], *[F.lit(0.0).alias(c) for c in LOSSES])
    each = sums.unionByName(none).groupBy("interval", *keys).agg(*[F.sum(c).alias(c) for c in (*COUNTS, *LOSSES)])
    later = Window.partitionBy(*keys).orderBy(F.col("interval").desc()).rowsBetween(Window.unboundedPreceding, 0)
    since = each.select(F.get(dates, F.col("interval") - 1).alias("cutoff"), *keys, *[F.sum(c).over(later).alias(c) for c in (*COUNTS, *LOSSES)])
    return from_sums(since.where("records > 0"), ("cutoff", *keys))


def from_sums(agg: DataFrame, keys=KEYS) -> DataFrame:
    """The metrics of rows of COUNTS and LOSSES."""
    r, ups, tp, tn, pp, np_ = (F.col(c).cast("double") for c in ("records", "ups", "tp", "tn", "pos_preds", "neg_preds"))
    both, fp, fn = (ups > 0) & (ups < r), pp - tp, np_ - tn
    mcc = div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    prec, nprec = div(tp, pp), div(tn, np_)
    sprec, snprec = div(F.col("sure_tp"), F.col("sure_pos")), div(F.col("sure_tn"), F.col("sure_neg"))
    return agg.select(
        *keys, "records", rnd(ups / r, 6).alias("pos_rate"), rnd((prec + nprec) / 2, 2).alias("bal_prec"), rnd((sprec + snprec) / 2, 2).alias("bal_prec_th"), rnd(F.col("brier_sum") / r, 6).alias("brier"),
        F.when(both, rnd(F.col("loss_sum") / r, 6)).alias("log_loss"), F.when(both & (pp > 0) & (np_ > 0), rnd(mcc, 6)).alias("mcc"), rnd(prec, 6).alias("pprec"), rnd(nprec, 6).alias("nprec"),
        rnd(F.col("sure") / r, 6).alias("cov_th"), rnd(sprec, 6).alias("pprec_th"), rnd(snprec, 6).alias("nprec_th"), "pos_preds", "neg_preds",
    )


def with_composite(metrics: DataFrame) -> DataFrame:
    c = F.col("bal_prec") * 0.5 + F.col("mcc") * 0.25 + (F.lit(1.0) - F.col("brier")) * 0.125 + F.col("bal_prec_th") * F.col("cov_th") * 0.1
    return metrics.withColumn("composite", rnd(c, 6))


def calibration(pred: DataFrame, bins: int = 10, keys=("horizon", "features")) -> DataFrame:
    """By key and quantile bin of pred (equal edges count once): n, mean pred, share of ups, least and largest pred.

    The edges are one array per key; bins are right-closed, the first takes its low edge too.
    """
    rows = pred.na.drop(subset=[*keys, "pred", "test_pos_n"]).select(*keys, "pred", "test_pos_n")
    edges = quantiles(rows, list(keys), "pred", [i / bins for i in range(bins + 1)]).select(*keys, F.array_distinct("quantiles").alias("edges"))
    joined = rows.join(edges, list(keys))
    joined = joined.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("pred")))))
    return joined.groupBy(*keys, "bin").agg(F.count("*").alias("n"), rnd(F.avg("pred"), 6).alias("p_mean"), rnd(F.avg(F.col("test_pos_n").cast("double")), 6).alias("y_rate"), F.min("pred").alias("p_min"), F.max("pred").alias("p_max"))


def bucket(streak: Column, k: int = 3) -> Column:
    return F.when(streak > k, k + 1).when(streak < -k, -(k + 1)).otherwise(streak)


def streak_buckets(pred: DataFrame, streaks: DataFrame, min_th: float = 0.55, keys=KEYS, k: int = 3) -> DataFrame:
    """By configuration: accuracy and count by streak of the labels, at the close (c) and before it (o), pair means, weighted scores.

    streaks: symbol, date, horizon, streak, streak_before. Both contexts are conditional aggregates of one grouping.
    """
    rows = pred.where(three_way(F.col("pred"), min_th).isNotNull()).join(streaks.select("symbol", "date", "horizon", "streak", "streak_before"), ["symbol", "date", "horizon"])
    rows = rows.withColumn("c", bucket(F.col("streak"), k)).withColumn("o", bucket(F.col("streak_before"), k))
    names = {b: f"{abs(b)}{'n' if b < 0 else 'p'}" for b in (1, -1, 2, -2, 3, -3, k + 1, -(k + 1))}
    aggs = [f for side in "co" for b, n in names.items() for f in (F.count_if(F.col(side) == b).alias(f"n_{n}_{side}"), F.avg(F.when(F.col(side) == b, F.col("acc").cast("double"))).alias(f"acc_{n}_{side}"))]
    out = rows.groupBy(*keys).agg(*aggs)
    pair = lambda b, s: (F.col(f"acc_{names[b]}_{s}") + F.col(f"acc_{names[-b]}_{s}")) / 2
    score = lambda s: rnd((pair(1, s) * 2.0 + pair(2, s) * 1.5 + pair(3, s) * 1.25 + pair(4, s)) / 5.75, 4)
    return out.select(*keys, *[c for side in "co" for n in names.values() for c in (f"n_{n}_{side}", rnd(F.col(f"acc_{n}_{side}"), 6).alias(f"acc_{n}_{side}"))], score("c").alias("wba_close"), score("o").alias("wba_open"))
