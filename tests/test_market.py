"""Market operators against small recurrences and hand-written cases, and the plans' shuffles."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketjobs.functions import rolling
from marketjobs.jobs import fitting
from marketjobs.operators import fit, folds, metrics, minutes, momentum, prune, scan, select, trend, volatility, volume

DAY = dt.date(2024, 1, 1)


def bars(spark, closes, symbol="s", **more):
    rows = []
    for i, c in enumerate(closes):
        r = {"symbol": symbol, "date": DAY + dt.timedelta(days=i), "open": c, "high": c, "low": c, "close": c, "volume": 10}
        rows.append(r | {k: v[i] for k, v in more.items()})
    return spark.createDataFrame(rows, "symbol string, date date, open long, high long, low long, close long, volume long")


def col(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


def test_half_even_and_division(spark):
    df = spark.createDataFrame([(0.125, 2.5, 1.0, 0.0)], "a double, b double, c double, d double")
    r = df.select(rolling.rnd(F.col("a"), 2).alias("x"), rolling.rnd(F.col("b"), 0).alias("y"), rolling.div(F.col("c"), F.col("d")).alias("z"), rolling.clean_inf(F.lit(float("inf"))).alias("i")).first()
    assert (r.x, r.y, r.z, r.i) == (0.12, 2.0, None, 0.0)


def test_warm_up_and_constant_prices(spark):
    df = bars(spark, [5] * 12)
    assert col(trend.sma_ratio(df, (5, 10)), "sma_10") == [None] * 9 + [1.0] * 3
    assert col(trend.zscores(df, (5,)), "zscore_5") == [None] * 12
    assert col(momentum.rsi(df, (3,), (1,)), "rsi_3_1") == [None] * 12
    assert col(momentum.rsi(bars(spark, range(1, 7)), (3,), (1,)), "rsi_3_1") == [None, None, 100.0, 100.0, 100.0, 100.0]
    assert col(momentum.williams_r(df, (5,)), "williams_5") == [None] * 12 and col(volume.cmf(df, (10,)), "cmf_10")[-1] == 0.0


def test_rows_since_takes_the_first_extreme(spark):
    df = bars(spark, [3, 9, 1, 9, 1, 5])
    out = trend.rows_since(df, (5,))
    assert col(out, "since_max_5")[-2:] == [3, 4] and col(out, "since_min_5")[-2:] == [2, 3]


def test_run_counter_is_the_recurrence(spark):
    rng = random.Random(5)
    for _ in range(6):
        closes = [rng.choice([10, 11, 12]) for _ in range(60)]
        want, v = [], 0
        for i, c in enumerate(closes):
            if i:
                m = sum(closes[i - 2 : i + 1]) / 3 if i >= 2 else None
                v = (v + 1 if v >= 0 else 0) if m is not None and c > m else (v - 1 if v <= 0 else 0) if m is not None and c < m else 0
            want.append(v)
        assert col(trend.num_days(bars(spark, closes), 3), "num_days_3") == want


@pytest.mark.parametrize("chunk", [4, 256])
def test_scan_is_ewm(spark, chunk):
    closes = [random.Random(i).randrange(900, 1100) for i in range(40)]
    df = bars(spark, closes)
    alpha = 2.0 / 13
    first = F.row_number().over(rolling.series()) == 1
    got = col(scan.scan(df, {"e": (F.when(first, F.col("close")).otherwise(F.col("close") * alpha), 1 - alpha)}, chunk), "e")
    assert np.allclose(got, pd.Series(closes).ewm(span=12, adjust=False).mean())
    got = col(scan.weighted(df, {"w": F.when(~first, F.col("close").cast("double"))}, 1 / 14), "w")
    want = pd.Series([np.nan, *closes[1:]]).ewm(alpha=1 / 14).mean()
    assert got[0] is None and np.allclose(got[1:], want[1:])


def test_streaks(spark):
    df = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), v) for i, v in enumerate([1, 1, 0, 0, 0, 1])], "symbol string, date date, label int")
    out = volatility.label_streak(df)
    assert col(out, "streak") == [1, 2, -1, -2, -3, 1] and col(out, "streak_before") == [0, 1, 2, -1, -2, -3]


def test_context_is_filled_from_matched_days_only(spark):
    ctx = spark.createDataFrame([(DAY, 1), (DAY + dt.timedelta(days=1), 2), (DAY + dt.timedelta(days=9), 3)], "date date, x int")
    assert col(volatility.with_context(bars(spark, [5] * 4), ctx), "x") == [1, 2, 2, 2]


def test_session_labels_on_boundaries(spark):
    times = {"07:00": "early_pre_market", "06:59": "overnight", "09:00": "late_pre_market", "09:30": "early_open", "09:45": "late_open", "10:00": "morning", "12:00": "midday", "14:00": "late_day", "15:30": "early_close", "15:45": "late_close", "16:00": "late_close", "16:01": "early_post_market", "16:15": "late_post_market", "17:00": "post_market_other", "20:00": "post_market_other", "20:01": "other"}
    for month, offset in ((1, 5), (7, 4)):
        rows = [(dt.datetime(2024, month, 3, *map(int, t.split(":"))) + dt.timedelta(hours=offset), t) for t in times]
        df = spark.createDataFrame(rows, "ts timestamp_ntz, t string")
        out = minutes.labelled(df, lambda d: d.select("date", F.lit("2024-01-03 16:00:00").cast("timestamp_ntz").alias("close_et")).distinct()).collect()
        assert {r.t: r.detail for r in out} == times and all(r.date == dt.date(2024, month, 3) for r in out)


def config(spark, rows):
    keys = [2, "m", 1, "a", 1.0, "together", 5]
    return spark.createDataFrame([(*keys, p, y) for p, y in rows], "horizon int, model string, train_years int, features string, pi_size double, pi_handling string, min_feats int, pred double, test_pos_n int")


def test_metrics_edges(spark):
    m = metrics.config_metrics(config(spark, [(0.9, 1), (0.8, 1), (0.45, 0), (0.55, 1), (0.6, None)])).first()
    assert m.records == 2 and m.log_loss is None and m.mcc is None and m.nprec is None and m.neg_preds == 0
    assert metrics.config_metrics(config(spark, [(0.5, 1)])).count() == 0
    m = metrics.config_metrics(config(spark, [(0.9, 1), (0.7, 0), (0.1, 0), (0.2, 1), (0.3, 0)])).first()
    y, p = np.array([1, 0, 0, 1, 0]), np.array([0.9, 0.7, 0.1, 0.2, 0.3])
    assert m.records == 5 and abs(m.brier - ((p - y) ** 2).mean()) < 1e-6 and abs(m.mcc - np.corrcoef(y, p > 0.5)[0, 1]) < 1e-6
    assert abs(m.log_loss + np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) < 1e-6


def test_edge_selection_falls_back(spark):
    row = lambda f, c: (2, "m", 1, f, 1.0, "t", 5, c, 0.5, 0.5, 0.5)
    df = spark.createDataFrame([row("a", 0.3), row("b", None), row("a", 0.2)], "horizon int, model string, train_years int, features string, pi_size double, pi_handling string, min_feats int, composite double, pos_rate double, pprec double, nprec double")
    assert [(r.features, r.composite) for r in select.edge_select(df, 0.07, 6, 2).orderBy("rank").collect()] == [("a", 0.3), ("b", None)]


@pytest.mark.parametrize(("step", "test", "purge"), [(5, 5, 5), (3, 7, 0), (10, 4, 2)])
def test_folds(spark, step, test, purge):
    rows = spark.createDataFrame([(s, DAY + dt.timedelta(days=i), i % 2) for s, n in (("a", 90), ("b", 33), ("c", 5)) for i in range(n)], "symbol string, date date, label int")
    numbered = folds.numbered(rows)
    plan = {(r.symbol, r.run): r for r in folds.plan(numbered.groupBy("symbol").agg(F.max("rn").alias("n")), 1, 8, step, test, purge, days=20).collect()}
    got = {}
    for r in folds.with_folds(numbered, 1, 8, step, test, purge, days=20).collect():
        got.setdefault((r.symbol, r.run), {"train": set(), "test": set()})[r.part].add(r.rn)
    assert set(got) == set(plan)
    for k, p in plan.items():
        assert got[k]["test"] == set(range(p.test_start, p.test_end + 1)) and got[k]["train"] == set(range(p.train_start, p.train_end + 1))
        assert len(got[k]["train"]) == 20 and p.test_start - p.train_end - 1 == purge


@pytest.mark.parametrize(("step", "test", "purge", "per"), [(5, 5, 5, 16), (3, 7, 0, 2), (10, 4, 2, 1)])
def test_slices_have_the_rows_of_their_folds(spark, step, test, purge, per):
    rows = spark.createDataFrame([(s, DAY + dt.timedelta(days=i), i % 2, float(i)) for s, n in (("a", 90), ("b", 33), ("c", 5)) for i in range(n)], "symbol string, date date, label int, x double")
    numbered = folds.numbered(rows)
    f = folds.Folds(20, test, step, purge, per_slice=per)
    seen = lambda x, y: lambda z: np.full(len(z), x.min() * 1000 + x.max())
    got = {}
    for r in fit.walk_forward(folds.with_slices(numbered, f), ["x"], f, seen).collect():
        got.setdefault((r.symbol, r.run), []).append((r.date, r.pred, r.train_n))
    plan = {(r.symbol, r.run): r for r in folds.plan(numbered.groupBy("symbol").agg(F.max("rn").alias("n")), 1, 99, step, test, purge, days=20).collect()}
    assert set(got) == set(plan)
    for k, p in plan.items():
        days = [DAY + dt.timedelta(days=i) for i in range(p.test_start - 1, p.test_end)]
        assert sorted(d for d, _, _ in got[k]) == days and {(x, n) for _, x, n in got[k]} == {((p.train_start - 1) * 1000.0 + p.train_end - 1, 20)}


def test_fits_cover_the_series(spark, monkeypatch):
    rows = [(s, DAY + dt.timedelta(days=i), *[0.0 if i == 50 else 100.0 + i * 7 % 13] * 4, 10) for s, n in (("a", 400), ("b", 330), ("c", 100)) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")
    monkeypatch.setattr(fitting, "bars_daily", lambda spark, sf_dir: bars)
    got = {(r.symbol, r.run): (r.n, r.d) for r in fitting.walk_forward_fit(spark, "").groupBy("symbol", "run").agg(F.count("*").alias("n"), F.countDistinct("date").alias("d")).collect()}
    runs = {s: (n - 5 - 255) // 5 + 1 for s, n in (("a", 400), ("b", 330))}
    assert got == {(s, i): (5, 5) for s, k in runs.items() for i in range(k)} and runs["a"] > 10


def test_stumps_learn_and_importance_is_repeatable(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] > 0).astype(float)
    assert ((fit.boosted_stumps(x[:300], y[:300])(x[300:]) > 0.5) == y[300:]).mean() > 0.95
    holes = np.c_[x, np.full(400, np.nan)]  # a feature without a value is left out, and nothing else
    assert ((fit.boosted_stumps(holes[:300], y[:300])(holes[300:]) > 0.5) == y[300:]).mean() > 0.95
    rows = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(400)], "symbol string, date date, label int, a double, b double")
    f = folds.Folds(train=300, test=100, step=100, purge=0)
    sliced = folds.with_slices(folds.numbered(rows), f)
    scored = fit.walk_forward(sliced, ["a", "b"], f)
    assert scored.count() == 100 and scored.where("(pred >= 0.5) = (label = 1)").count() > 95
    pi = {r.feature: r for r in fit.importance(sliced.repartition(7), ["a", "b"], f).collect()}
    assert pi["a"].pi_mean > 0.3 > abs(pi["b"].pi_mean) and pi["a"] == {r.feature: r for r in fit.importance(sliced, ["a", "b"], f).collect()}["a"]
    chosen = fit.chosen_features(spark.createDataFrame([("s", 0, "a", 0.4, 0.0), ("s", 0, "b", 0.001, 0.0), ("s", 0, "c", 0.0, 0.0)], "symbol string, run long, feature string, pi_mean double, pi_std double"))
    assert sorted(r.feature for r in chosen.collect()) == ["a", "b"]


def test_sets(spark):
    catalog = spark.createDataFrame([("x", "c1", 0), ("x", "c2", 1), ("y", "c2", 0), ("y", "c3", 1)], "set_name string, col_name string, pos int")
    out = prune.resolve_sets(spark.createDataFrame([("y-x",)], "name string"), catalog).first()
    assert out.cols == ["c2", "c3", "c1"]
    with pytest.raises(Exception, match="unknown feature set"):
        prune.resolve_sets(spark.createDataFrame([("x-nope",)], "name string"), catalog).collect()
    corr = spark.createDataFrame([("a", "b", 0, 1, 0.9), ("a", "c", 0, 2, 0.1), ("b", "c", 1, 2, 0.2)], "a string, b string, i int, j int, r double")
    target = spark.createDataFrame([("a", 0, 0.1), ("b", 1, -0.5), ("c", 2, 0.3)], "col string, pos int, r double")
    assert sorted(r.col for r in prune.representatives(corr, target, 0.5).collect()) == ["b", "c"] and [r.dropped for r in prune.pruned(corr, 0.5).collect()] == ["b"]


def test_representatives_of_a_chain(spark):
    """a ~ b ~ c, and c opens a cluster of its own with b, which is used and still the best of it."""
    corr = spark.createDataFrame([("a", "b", 0, 1, 0.9), ("a", "c", 0, 2, 0.1), ("b", "c", 1, 2, -0.9), ("a", "d", 0, 3, None)], "a string, b string, i int, j int, r double")
    target = spark.createDataFrame([("a", 0, 0.2), ("b", 1, -0.5), ("c", 2, 0.3), ("d", 3, None)], "col string, pos int, r double")
    assert sorted(r.col for r in prune.representatives(corr, target, 0.5).collect()) == ["b", "d"]


def outcome(rows, c, sets, names, end):
    """Chosen features and rates of one fold in plain Python; rows up to `end` (from 1) are known."""
    part = rows[end - c.pi_rows : end]
    hits = lambda own: max(sum(r[1] for r in own), len(own) - sum(r[1] for r in own))
    gain = {f: sum(hits([r for r in part if r[2][f] == k]) for k in range(3)) - hits(part) for f in names}
    best = lambda own: sorted(own, key=lambda f: (-gain[f], f))

    def take(own, limit, least, most=99):
        good = [f for f in best(own) if gain[f] * 100 > limit * c.pi_rows]
        return (good if len(good) >= least else best(own)[:least])[:most]

    own = [sets[s] for s in c.features.split("-")]
    new = own[1] if len(own) > 1 else []
    chosen = {
        "together": lambda: take([f for p in own for f in p], 3, c.min_feats), "separately": lambda: [f for p in own for f in take(p, 3, c.min_feats)],
        "exclude_new": lambda: [*take(own[0], 3, c.min_feats), *new], "cap_new": lambda: [*take(own[0], 3, c.min_feats), *take(new, 1, 0, 4)],
    }[c.pi_handling]()
    train, rate = rows[end - c.train : end], {}
    for f in chosen:
        for k in range(3):
            hit = [r[1] for r in train if r[2][f] == k]
            rate[f, k] = (sum(hit) + 1) / (len(hit) + 2)
    return chosen, rate


@pytest.mark.parametrize("horizon", [2, 5])
def test_grid_is_the_plain_walk(spark, monkeypatch, horizon):
    from marketjobs.operators import walk

    monkeypatch.setattr(walk, "DAYS_A_YEAR", 40)
    monkeypatch.setattr(walk, "PI_DAYS", 30)
    rng, sets = random.Random(horizon), {"x": ("f", "g"), "y": ("h",)}
    names, n, test = ["f", "g", "h"], 120, 5
    series = {s: [(i + 1, None if i >= n - horizon else int(rng.random() < 0.5), {k: rng.randrange(3) for k in names}) for i in range(n)] for s in "ab"}
    for rows in series.values():  # h says more than the others
        for i, (rn, y, own) in enumerate(rows):
            if y is not None and rng.random() < 0.6:
                rows[i] = (rn, y, own | {"h": 2 * y})
    df = spark.createDataFrame([(s, DAY + dt.timedelta(days=rn), rn, n, y, *own.values()) for s, rows in series.items() for rn, y, own in rows], "symbol string, date date, rn int, n int, label int, f int, g int, h int")
    configs = [walk.Config(y, f, 1.0, h, m) for y in (1, 2) for f in ("x", "x-y") for h in walk.MODES for m in (1, 2) if f == "x-y" or h == "together"]
    got = {(r.symbol, r.date, *(r[k] for k in metrics.KEYS)): r for r in walk.run_grid(df, horizon, test, configs, sets).collect()}
    want = 0
    for s, rows in series.items():
        for c in configs:
            for rn, y, own in rows[: n - horizon]:
                run = (n - horizon - rn) // test
                end = n - horizon - run * test - test - horizon
                if end < c.train:
                    continue
                want += 1
                chosen, rate = outcome(rows, c, sets, names, end)
                r = got[s, DAY + dt.timedelta(days=rn), horizon, "rate", c.train_years, c.features, 1.0, c.pi_handling, c.min_feats]
                raw = sum(rate[f, own[f]] for f in chosen) / len(chosen)
                assert r.n_features == len(set(chosen)) and abs(r.pred - raw) <= 0.025 + 1e-5 and (r.run, r.test_pos_n, r.train_n) == (run, y, c.train)
                assert r.train_end == DAY + dt.timedelta(days=end) and r.train_start == DAY + dt.timedelta(days=end - c.train + 1) and r.acc == int(r.pred_class == y)
    assert len(got) == want > 0
    newest = walk.run_grid(df, horizon, test, configs, sets, last_only=True).collect()
    assert {(r.symbol, (r.date - DAY).days) for r in newest} == {(s, n - i) for s in "ab" for i in range(horizon)} and all(r.test_pos_n is None and r.acc is None for r in newest)
    assert all((r.train_end - DAY).days == n - 2 * horizon for r in newest)


@pytest.mark.parametrize("horizon", [2, 5])
def test_joined_grid_is_the_carried_one(spark, monkeypatch, horizon):
    """All axes, a series that is shorter than the others, one without folds and a null symbol; the margin is squashed as in plain Python."""
    from marketjobs.operators import walk

    monkeypatch.setattr(walk, "DAYS_A_YEAR", 40)
    monkeypatch.setattr(walk, "PI_DAYS", 30)
    rng, sets, names, test = random.Random(horizon), {"x": ("f", "g"), "y": ("h", "g")}, ["f", "g", "h"], 5
    series = {s: [(i + 1, None if i >= n - horizon else int(rng.random() < 0.6), {k: rng.randrange(3) for k in names}) for i in range(n)] for s, n in (("a", 131), ("b", 70), ("c", 12), (None, 60))}
    df = spark.createDataFrame([(s, DAY + dt.timedelta(days=rn), rn, len(rows), y, *own.values()) for s, rows in series.items() for rn, y, own in rows], "symbol string, date date, rn int, n int, label int, f int, g int, h int")
    configs = [walk.Config(y, f, p, h, 1, m) for y in (1, 2) for f in ("x", "x-y") for p in (0.5, 1.0) for h in walk.MODES for m in walk.MODELS if f == "x-y" or h == "together"]
    got, want = walk.grid_joined(df, horizon, test, configs, sets), walk.run_grid(df, horizon, test, configs, sets)
    rows = got.collect()
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and {r.symbol for r in rows} == {"a", "b", None}
    squashed = 0
    for r in rows:
        if r.model == "margin" and r.pi_handling == "together":
            own = series[r.symbol]
            end, c = (r.train_end - DAY).days, walk.Config(r.train_years, r.features, r.pi_size, r.pi_handling, r.min_feats)
            unique = {k: tuple(f for f in v if k == "x" or f != "g") for k, v in sets.items()}
            chosen, rate = outcome(own, c, unique, names, end)
            score = sum(4 * (rate[f, own[(r.date - DAY).days - 1][2][f]] - 0.5) for f in chosen)
            assert abs(r.pred - 1 / (1 + math.exp(-score))) <= 0.025 + 1e-5 and r.pred_class == int(score >= 0) or abs(score) < 1e-5
            squashed += 1
    assert squashed > 100 and walk.grid_joined(df.where("false"), horizon, test, configs, sets).isEmpty()


def test_folds_of_the_joined_grid_are_many_tasks(spark):
    """Configurations are joined by train length, not paired with every fold; one symbol's folds are scored in several tasks."""
    from marketjobs.operators import walk

    n = 400
    df = spark.range(1, n + 1).select(F.lit("a").alias("symbol"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), F.col("id").cast("int").alias("rn"), F.lit(n).alias("n"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("f"))
    out = walk.grid_joined(df, 1, 5, [walk.Config(1, "x", p, "together", 1, m) for p in (0.5, 1.0) for m in walk.MODELS], {"x": ("f",)})
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 0.3 * sum(sizes) and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_filter_of_each_horizon(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.6), (2, 0.9), (2, 0.7), (3, 0.5)], "horizon int, pred double")
    best = lambda rows: rows.join(rows.agg(F.max("pred").alias("m")), F.col("pred") == F.col("m")).drop("m")
    assert sorted(tuple(r) for r in metrics.filtered(df, (1, 2, 4), best).collect()) == [(1, 0.6), (2, 0.9)]
    with pytest.raises(ValueError, match="no horizons"):
        metrics.filtered(df, (), best)


def test_modes_are_checked():
    from marketjobs.operators import walk

    with pytest.raises(ValueError, match="unknown handling"):
        walk.checked([walk.Config(1, "x", 1.0, "run_together", 1)], {"x": ("f",)})
    with pytest.raises(KeyError, match="nope"):
        walk.checked([walk.Config(1, "x-nope", 1.0, "together", 1)], {"x": ("f",)})
    with pytest.raises(ValueError, match="unknown model"):
        walk.checked([walk.Config(1, "x", 1.0, "together", 1, "other")], {"x": ("f",)})


def test_squash_and_infinities(spark):
    df = spark.createDataFrame([(0.0, float("inf"), None), (2.0, float("-inf"), 0.126)], "s double, x double, y double")
    out = rolling.rounded(rolling.without_inf(df.withColumn("p", metrics.logistic(F.col("s"))), ["x", "y"])).collect()
    assert [(r.x, r.y, r.p) for r in out] == [(0.0, None, 0.5), (0.0, 0.13, 0.88)]


def test_scans_and_the_panel_move_bars_once(spark, monkeypatch):
    df = bars(spark, range(1, 50)).repartition(3)
    monkeypatch.setattr(fitting, "bars_daily", lambda spark, sf_dir: df)
    for out in (scan.macd(df), scan.adx(df), fitting.feature_panel(spark, "")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {c for p in fitting.SETS.values() for c in p}


def test_daily_windows_share_one_shuffle(spark):
    df = bars(spark, range(1, 50)).repartition(3)
    for op in (trend.sma_ratio, trend.sma_lag, momentum.rsi, volume.obv, volatility.atr):
        plan = op(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(symbol") == 1


def test_entry(spark):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and entry.entry(spark).count() == 5


@pytest.mark.parametrize("chunk", [7, 40])
def test_chunks_with_halo_equal_whole_series(spark, chunk):
    from marketjobs.functions.chunks import by_chunks

    rng = random.Random(chunk)
    rows = [(s, DAY + dt.timedelta(days=i * rng.randrange(1, 2) + (9000 if i > 50 else 0)), *[rng.randrange(90, 110) for _ in range(4)], 5) for s, n in (("a", 100), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date date, open long, high long, low long, close long, volume long")
    for op, back, ahead in ((trend.sma_ratio, 14, 0), (lambda d: momentum.rsi(d, (14,), (1, 3)), 17, 0), (lambda d: momentum.fwd_return(d, (5,)), 0, 5)):
        assert sorted(map(str, by_chunks(df, op, back, chunk, ahead).select(op(df).columns).collect())) == sorted(map(str, op(df).collect()))


def test_history(spark, tmp_path):
    """A retry changes nothing, a run that broke off is not read and is written anew, runs add up, one horizon is read by its partitions."""
    from marketjobs.sources import history

    df = spark.createDataFrame([(1, 0.5, 2), (2, 0.6, 5)], "run int, pred double, horizon int")
    path = str(tmp_path / "h")
    assert history.load(spark, path, df.schema).count() == 0
    with pytest.raises(FileNotFoundError):
        history.load(spark, path)
    assert history.append(df, path, "one") and not history.append(df.unionByName(df), path, "one")
    df.unionByName(df).write.partitionBy("horizon").parquet(f"{path}/rows/batch=two")  # without its mark
    assert history.load(spark, path, df.schema).count() == 2
    assert history.append(df, path, "two") and history.load(spark, path).count() == 4
    one = history.load(spark, path, horizon=5)
    assert one.columns == df.columns and [tuple(r) for r in one.collect()] == [(2, 0.6, 5)] * 2
    assert "PartitionFilters: [isnotnull(horizon" in one._jdf.queryExecution().toString()
    assert history.append(df.where("false"), path + "0", "none") and history.load(spark, path + "0").schema == df.schema and history.load(spark, path + "0").isEmpty()
    with pytest.raises(ValueError, match="name of a run"):
        history.append(df, path, "../x")
    with pytest.raises(ValueError, match="1 rows"):
        history.checked_times(spark.createDataFrame([("2024-01-01",), ("x",)], "t string"), "t")


def test_stored_once_for_the_same_tables(spark, tmp_path):
    from marketjobs.sources.shared import once, path_of

    made, table = [], str(tmp_path / "t.parquet")
    make = lambda: made.append(1) or spark.range(len(made))
    spark.range(3).write.parquet(table)
    count = lambda: once(spark, path_of(spark, "x", table), make).count()
    assert (count(), count(), len(made)) == (1, 1, 1)
    spark.range(4).write.mode("append").parquet(table)
    assert (count(), len(made)) == (2, 2)


def test_pending_days_are_appended_once(spark):
    from marketjobs.jobs import loop
    from marketjobs.sources import history

    sf = "/root/testdata/sf0.01"
    rows = loop.panel(spark, sf)
    path = loop.known_history(spark, sf)
    before, found = history.load(spark, path).count(), loop.pending(spark, rows, path)
    n = found.count()
    assert n > 0 and history.append(found, path, "pending") and not history.append(found, path, "pending")
    assert history.load(spark, path).count() == before + n and loop.pending(spark, rows, path).isEmpty()


def test_cutoffs_are_metrics_of_later_predictions(spark):
    """Against a plain filter for each cutoff: unordered and repeated dates, cutoffs after the last prediction, keys without late ones."""
    rng = random.Random(9)
    rows = [(2, k, DAY + dt.timedelta(days=rng.randrange(60 if k == "a" else 20)), rng.choice([0.2, 0.4, 0.5, 0.6, 0.9, None]), rng.choice([0, 1, None])) for k in "ab" for _ in range(200)]
    df = spark.createDataFrame(rows, "horizon int, model string, date date, pred double, test_pos_n int")
    cutoffs, keys = ["2024-01-31", "2023-01-01", "2024-01-11", "2024-01-31", "2025-01-01"], ("horizon", "model")
    want = [("cutoff", c, *r) for c in set(cutoffs) for r in metrics.config_metrics(df.where(F.col("date") >= F.lit(c).cast("date")), keys=keys).collect()]
    out = [("cutoff", str(r[0]), *r[1:]) for r in metrics.cutoff_metrics(df, cutoffs, keys=keys).collect()]
    assert sorted(map(str, out)) == sorted(map(str, want)) and len(out) == 5
    with pytest.raises(ValueError, match="no cutoff"):
        metrics.cutoff_metrics(df, [])


@pytest.mark.parametrize("block", [1000, 7, 1])
def test_wide_correlations(spark, block):
    """Missing, infinite and constant values, large means, few rows; blocks of any width agree with plain sums."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 1e7
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3], x[5, 4], x[2:, 5] = 7.0, np.inf, np.nan
    names = [f"f.{k}" for k in range(12)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(5)
    x[5, 4] = np.nan

    def plain(i: int, j: int) -> float | None:
        """From centred values; pandas gives 1.000000001 for two rows near 1e7."""
        both = x[np.isfinite(x[:, i]) & np.isfinite(x[:, j])][:, [i, j]]
        p, q = (both - both.mean(0)).T
        return None if not p.any() or not q.any() else (p * q).sum() / np.sqrt((p * p).sum() * (q * q).sum())

    out = prune.correlations_wide(df, names, block).collect()
    assert sorted((r.i, r.j) for r in out) == [(i, j) for i in range(12) for j in range(i + 1, 12) if pd.DataFrame(x)[[i, j]].notna().all(axis=1).any()]
    for r in out:
        assert (r.a, r.b) == (names[r.i], names[r.j])
        w = plain(r.i, r.j)
        assert r.r is None if w is None else r.r == pytest.approx(w, abs=1e-9)
    assert prune.correlations_wide(df.where("false"), names).isEmpty()


def test_deduplicated_orders_ties_fully(spark):
    rows = [("a", 1, 0.5, x) for x in (3, None, 2)] + [("a", 0, 0.1, 0), ("b", 2, None, 1)]
    df = spark.createDataFrame(rows, "symbol string, run int, pred double, other int")
    for again in (df, df.orderBy(F.desc_nulls_last("other")), df.unionByName(df).repartition(3)):
        assert sorted(map(tuple, select.deduplicated(again, keys=("symbol",)).collect())) == [("a", 1, 0.5, None), ("b", 2, None, 1)]
