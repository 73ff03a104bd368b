"""Scans in segments against whole series, and the number of tasks that one symbol makes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketjobs.functions.segments import before, run_length, running_sum
from marketjobs.functions.chunks import numbered
from marketjobs.functions.extremes import moving, moving_extremes
from marketjobs.operators import momentum, scan, trend, volatility, volume

RNG = random.Random(23)


def bars(spark, n: int = 400):
    rows = []
    for s in ("a", None, "c"):
        day = 0
        for _ in range(n):
            day += RNG.choice([1, 1, 1, 4, 60])
            low, high = sorted((RNG.randrange(50, 60), RNG.randrange(50, 60)))
            rows.append((s, day, RNG.randrange(low, high + 1), high, low, RNG.randrange(low, high + 1), RNG.randrange(0, 9)))
    df = spark.createDataFrame(rows, "symbol string, day int, open long, high long, low long, close long, volume long")
    return df.withColumn("date", F.date_add(F.lit("1969-01-01").cast("date"), F.col("day"))).drop("day").repartition(3)


@pytest.mark.parametrize(("chunk", "days"), [(30, 40), (64, 900), (1000, 5)])
def test_sums_and_scores_equal_whole_series(spark, chunk, days):
    df = bars(spark).where("symbol is not null")
    for long, whole in ((volume.obv_long, volume.obv), (volume.adl_long, volume.adl)):
        want = whole(df)
        assert sorted(map(str, long(df, chunk=chunk, days=days).select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("days", [1, 7, 400, 100_000])
@pytest.mark.parametrize("share", [0.5, 0.97])
def test_streaks_equal_whole_series(spark, days, share):
    """Runs that are longer than segments, empty segments, unknown labels, a null symbol."""
    df = bars(spark).select("symbol", "date").collect()
    labels = spark.createDataFrame([(r.symbol, r.date, RNG.choice([None, 0, 0]) if RNG.random() > share else 1) for r in df], "symbol string, date date, label int")
    want = volatility.label_streak(labels)
    assert sorted(map(str, volatility.label_streak_long(labels, days).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_one_symbol_is_many_tasks(spark):
    """The rows of one symbol are scanned in several partitions, in a sum as in runs."""
    df = bars(spark).where("symbol = 'a'")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out, made in ((running_sum(df, F.col("volume"), "total", 30), "total"), (run_length(df.withColumn("v", F.col("volume") % 2), "v", 30), "__run")):
            rows = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.max(made), F.count("*").alias("n")).collect()]
            assert len(rows) >= 3 and max(rows) < 0.6 * sum(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_no_rows(spark):
    assert running_sum(bars(spark).where("false"), F.col("volume"), "total").isEmpty()
    assert volatility.label_streak_long(spark.createDataFrame([], "symbol string, date date, label int")).isEmpty()


@pytest.mark.parametrize("w", [1, 2, 5, 7, 50, 399, 400, 1000])
def test_moving_extremes(spark, w):
    """Against whole frames: windows as long as a series and longer, missing values, ties."""
    rows = numbered(bars(spark).where("symbol is not null").withColumn("x", F.when(F.col("volume") > 1, F.col("volume"))))
    frame = Window.partitionBy("symbol").orderBy("rn").rowsBetween(1 - w, 0)
    want = rows.select("*", *[F.when(F.col("rn") >= w - 1, f("x").over(frame)).alias(n) for n, f in (("hi", F.max), ("lo", F.min))])
    out = moving_extremes(rows, w, {"hi": F.col("x")}, {"lo": F.col("x")})
    assert sorted(map(str, out.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_extremes_of_long_frames_equal_the_short_ones(spark):
    df = bars(spark).where("symbol is not null")
    out = trend.extremes_long(df, (5, 50))
    for whole in (trend.rows_since(df, (5, 50)), trend.close_rel(df, (5, 50)).select("symbol", "date", *[f"close_rel_{m}_{w}" for m in ("max", "min") for w in (5, 50)])):
        assert sorted(map(str, out.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert trend.extremes_long(df.where("false")).isEmpty()


def test_extremes_of_one_symbol_are_many_tasks(spark):
    plan = trend.extremes_long(bars(spark), (5,))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__block" in line]
    assert len(windows) == 2 and "hashpartitioning(symbol" in plan and "__block" in plan.split("hashpartitioning(symbol")[1][:30]


@pytest.mark.parametrize("w", [1, 2, 7, 50, 399, 400, 1000])
def test_moving_sums(spark, w):
    """Each row counts once, also where a window is a whole block; missing values, windows as long as a series and longer."""
    rows = numbered(bars(spark).where("symbol is not null").withColumn("x", F.when(F.col("volume") > 1, F.col("volume"))))
    frame = Window.partitionBy("symbol").orderBy("rn").rowsBetween(1 - w, 0)
    want = rows.select("*", F.when(F.col("rn") >= w - 1, F.sum("x").over(frame)).alias("total"))
    out = moving(rows, w, {"total": (F.sum, F.col("x"))})
    assert sorted(map(str, out.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("days", [1, 30, 100_000])
def test_row_before(spark, days):
    """Also missing values, which are handed on as such, empty segments and a null symbol."""
    df = bars(spark).withColumn("x", F.when(F.col("volume") > 1, F.col("volume")))
    want = df.select("symbol", "date", F.lag("x").over(Window.partitionBy("symbol").orderBy("date")).alias("old"))
    assert sorted(map(str, before(df, "x", "old", days).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_moments_of_long_frames_equal_the_short_ones(spark):
    df = bars(spark).where("symbol is not null")
    out = trend.moments_long(df, (5, 50, 600), days=90)
    for whole in (trend.zscores(df, (5, 50)), momentum.bollinger(df, 50).select("symbol", "date", F.col("bb_high").alias("bb_high_50"), F.col("bb_low").alias("bb_low_50"))):
        assert sorted(map(str, out.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    short = {(r.symbol, r.date): r for r in volatility.volatility(df, (5,)).collect()}
    for r in out.collect():
        assert r.zscore_600 is None and r.volatility_600 is None
        assert r.volatility_5 is None or abs(r.volatility_5 - short[r.symbol, r.date].volatility_5) < 1e-9
    zero = df.withColumn("close", F.when(F.col("volume") > 3, F.col("close")).otherwise(0))
    assert trend.moments_long(zero, (5,)).count() == df.count() and trend.moments_long(df.where("false")).isEmpty()


@pytest.mark.parametrize("chunk", [400, 1024])
def test_exponential_means_of_long_symbols_equal_whole_series(spark, chunk):
    """Chunks that begin in the middle of a series, at prices that move far; rounded values may differ by one step at a tie."""
    rng, rows, day = random.Random(chunk), [], 0
    for i in range(2500):
        day += rng.choice([1, 3])
        low, high = sorted((rng.randrange(10**6, 3 * 10**6), rng.randrange(10**6, 3 * 10**6)))
        rows.append(("a" if i % 2500 else "b", day, low, high, low, rng.randrange(low, high + 1), 1))
    df = spark.createDataFrame(rows, "symbol string, day int, open long, high long, low long, close long, volume long")
    df = df.withColumn("date", F.date_add(F.lit("1969-01-01").cast("date"), F.col("day"))).drop("day").repartition(3)
    for long, whole, names in ((scan.macd_long, scan.macd, ("macd", "macd_signal")), (scan.adx_long, scan.adx, ("plus_di", "minus_di", "adx"))):
        want = {(r.symbol, r.date): r for r in whole(df).collect()}
        got = {(r.symbol, r.date): r for r in long(df, chunk=chunk).collect()}
        assert got.keys() == want.keys() and len(got) == 2500
        for key, r in got.items():
            for n in names:
                assert (r[n] is None) == (want[key][n] is None) and (r[n] is None or abs(r[n] - want[key][n]) <= 1.001e-3)
        assert sum(got[k] != want[k] for k in got) <= 2
