"""Walk-forward over a grid of configurations with a relational model: selection of features, fit and score of every fold by running counts.

A feature of a row is one of BUCKETS numbers. What a fold needs of its train rows are counts of rows and of ups by feature and bucket,
and these are differences of running counts at the fold's ends: no row is copied into a fold, and a symbol's folds and configurations
are all fitted and scored in one pass over its rows in date order, behind one shuffle.

The importance of a feature is what knowing its bucket adds to the rows called rightly by the majority, on the newest train rows. The model is the mean, over the
chosen features, of the share of ups in the row's bucket (add-one, in millionths): `rate` takes it as it is, `margin` squashes a decision score.

`run_grid` carries the models of all configurations from a fold's end to its test rows, in one array. `grid_joined` is for large grids: configurations
are a table, joined to the folds, and test rows meet their fold's models in one join.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import lag, rnd, series, upto
from .folds import DAYS_A_YEAR
from .metrics import KEYS, logistic, on_grid

BUCKETS = 3
#: Rows a year that importance is taken from; a feature above LIMIT hundredths of them is important, a new one above NEW_LIMIT; at most NEW_MOST new ones.
PI_DAYS, LIMIT, NEW_LIMIT, NEW_MOST = 242, 3, 1, 4
MODES = ("together", "separately", "exclude_new", "cap_new")
#: Tasks for each core that folds are dealt to.
TASKS = 4
#: Mean rate, and the logistic of the sum of 4 (rate - 1/2) over the chosen features, which is about that of their log odds.
MODELS = ("rate", "margin")


@dataclass(frozen=True)
class Config:
    """A point of the grid. features: names of sets joined by -, of which the last, if there are several, is the new one."""

    train_years: int
    features: str
    pi_size: float
    pi_handling: str
    min_feats: int
    model: str = "rate"

    @property
    def train(self) -> int:
        return DAYS_A_YEAR * self.train_years

    @property
    def pi_rows(self) -> int:
        return min(self.train, int(PI_DAYS * self.pi_size))


def checked(configs: Iterable[Config], sets: dict[str, tuple[str, ...]]) -> list[Config]:
    """The configurations; unknown modes and sets raise."""
    found = list(configs)
    for c in found:
        if c.model not in MODELS:
            raise ValueError(f"unknown model {c.model!r}: one of {', '.join(MODELS)}")
        if c.pi_handling not in MODES:
            raise ValueError(f"unknown handling {c.pi_handling!r}: one of {', '.join(MODES)}")
        if unknown := [s for s in c.features.split("-") if s not in sets]:
            raise KeyError(f"unknown feature sets: {unknown}")
    return found


def bucket(x: Column) -> Column:
    """0, 1, 2 for a fall, none or an unknown change, and a rise."""
    return F.coalesce(F.signum(x).cast("int") + 1, F.lit(1))


def counted(rows: DataFrame, features: list[str], lengths: set[int]) -> DataFrame:
    """rows (symbol, date, rn, label, features) with seen_w and ups_w for each length w: of the last w rows, by feature and bucket, in one array; null before."""
    cells = [(F.col(f) == k) for f in features for k in range(BUCKETS)]
    out = rows.select("*", F.array(*[F.count_if(c).over(upto()) for c in cells]).alias("seen"), F.array(*[F.sum(F.when(c, F.coalesce("label", F.lit(0))).otherwise(0)).over(upto()) for c in cells]).alias("ups"))
    last = lambda c, w: F.when(F.col("rn") > w, F.zip_with(c, lag(c, w), lambda a, b: a - b)).when(F.col("rn") == w, F.col(c)).alias(f"{c}_{w}")
    return out.select(*rows.columns, *[last(c, w) for w in sorted(lengths) for c in ("seen", "ups")])


def importances(features: list[str], w: int) -> Column:
    """Rows called rightly beyond the plain majority, by feature, among the last w rows."""
    one = lambda i: F.slice(F.zip_with(f"seen_{w}", f"ups_{w}", lambda n, u: F.greatest(u, n - u)), 1 + BUCKETS * i, BUCKETS)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    up = total(F.slice(f"ups_{w}", 1, BUCKETS))
    return F.array(*[total(one(i)) - F.greatest(up, F.lit(w) - up) for i in range(len(features))])


def parts(c: Config, names: list[str], sets: dict[str, tuple[str, ...]]) -> list[dict]:
    """What a configuration selects from, part by part: the features above a limit, or else the best `least`, and of these at most `most`."""
    own = [sets[s] for s in c.features.split("-")]
    every = list(dict.fromkeys(f for p in own for f in p))
    new = [f for f in own[-1] if f not in {x for p in own[:-1] for x in p}] if len(own) > 1 else []
    old = [f for f in every if f not in new]
    part = lambda fs, limit=LIMIT, least=c.min_feats, most=len(names): {"members": [names.index(f) for f in fs], "limit": limit, "least": least, "most": most}
    if c.pi_handling == "together" or not new:
        return [part(every)]
    if c.pi_handling == "separately":
        return [part(p) for p in own]
    return [part(old), part(new, -(10**6), 0) if c.pi_handling == "exclude_new" else part(new, NEW_LIMIT, 0, NEW_MOST)]


CONFIG = "model string, train_years int, features string, pi_size double, pi_handling string, min_feats int, train int, train_at int, pi_rows int, pi_at int, parts array<struct<members array<int>, limit int, least int, most int>>"


def literal(configs: list[Config], names: list[str], sets: dict[str, tuple[str, ...]]) -> Column:
    """The configurations as one array: they are data to a single expression. train_at and pi_at: the places of their lengths among all."""
    trains, pis = sorted({c.train for c in configs}), sorted({c.pi_rows for c in configs})
    rows = [asdict(c) | {"train": c.train, "train_at": trains.index(c.train), "pi_rows": c.pi_rows, "pi_at": pis.index(c.pi_rows), "parts": parts(c, names, sets)} for c in configs]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{CONFIG}>>")


def selection(c: Column, names: list[str]) -> Column:
    """Places, in names, of the features that a configuration chooses, each once, in order; from the column gains."""

    def pick(part: Column) -> Column:
        ranked = F.array_sort(F.transform(part["members"], lambda i: F.struct((-F.get(F.get("gains", c["pi_at"]), i)).alias("g"), F.get(F.array(*[F.lit(n) for n in names]), i).alias("f"), i.alias("i"))))
        good = F.filter(ranked, lambda x: -x["g"] * 100 > part["limit"] * c["pi_rows"])
        return F.transform(F.slice(F.when(F.size(good) >= part["least"], good).otherwise(F.slice(ranked, F.lit(1), part["least"])), F.lit(1), part["most"]), lambda x: x["i"])

    return F.array_sort(F.array_distinct(F.flatten(F.transform(c["parts"], pick))))


def made(c: Column, names: list[str]) -> Column:
    """The model of a configuration, on the last train row of a fold: from the columns date, firsts, rates and gains."""
    own = [c[k].alias(k) for k in KEYS if k != "horizon"]
    return F.struct(*own, c["train"].alias("train_n"), F.get("firsts", c["train_at"]).alias("train_start"), F.col("date").alias("train_end"), selection(c, names).alias("chosen"), F.get("rates", c["train_at"]).alias("rates"))


def fitted(rows: DataFrame, at: Column, configs: list[Config], sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows with __at, firsts (of each train length), and where `at` holds rates (of each train length) and gains (of each length of importance)."""
    names = names_of(sets)
    trains, pis = sorted({c.train for c in configs}), sorted({c.pi_rows for c in configs})
    rate = lambda n, u: F.rint((u + 1) * 1e6 / (n + 2)).cast("long")
    out = counted(rows, names, {*trains, *pis}).withColumns({"__at": at, "firsts": F.array(*[lag("date", w - 1) for w in trains])})
    return out.withColumns({
        "rates": F.when(F.col("__at"), F.array(*[F.zip_with(f"seen_{w}", f"ups_{w}", rate) for w in trains])),
        "gains": F.when(F.col("__at"), F.array(*[importances(names, w) for w in pis])),
    })


def models(rows: DataFrame, at: Column, configs: list[Config], sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows (symbol, date, rn, label, features) with `made` on the rows where `at` holds: for each configuration that has its train rows
    up to this one, the chosen features and the rates of all features and buckets; null on other rows."""
    names, out = names_of(sets), fitted(rows, at, configs, sets)
    fitting = F.filter(literal(configs, names, sets), lambda c: F.col("rn") >= c["train"])
    return out.select(*rows.columns, F.when(F.col("__at"), F.transform(fitting, lambda c: made(c, names))).alias("made"))


def scored(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (symbol, date, horizon, label, run, test_days, test_end, features, made: one of them) -> predictions. Outcome columns are null where the label is."""
    own = F.array(*[F.col(f) for f in names])
    total = F.aggregate("made.chosen", F.lit(0).cast("long"), lambda a, i: a + F.get("made.rates", i * BUCKETS + F.get(own, i)))
    n = F.size("made.chosen")
    raw = F.when(F.col("made.model") == "margin", logistic((total - n * 500_000).cast("double") * 4 / 1e6)).otherwise(total.cast("double") / n / 1e6)
    out = rows.where(F.size("made.chosen") > 0).withColumn("raw", raw).withColumn("pred_class", (F.col("raw") >= 0.5).cast("int"))
    return out.select(
        "symbol", "date", *[F.col(k) if k == "horizon" else F.col(f"made.{k}") for k in KEYS], "run", "test_days", on_grid(F.col("raw")).alias("pred"), "pred_class", F.col("label").alias("test_pos_n"),
        (F.col("pred_class") == F.col("label")).cast("int").alias("acc"), "made.train_n", "made.train_start", "made.train_end", "test_end", F.size("made.chosen").alias("n_features"),
    )


def names_of(sets: dict[str, tuple[str, ...]]) -> list[str]:
    return list(dict.fromkeys(f for own in sets.values() for f in own))


def run_grid(rows: DataFrame, horizon: int, test: int, configs: list[Config], sets: dict[str, tuple[str, ...]], last_only: bool = False) -> DataFrame:
    """Predictions of all test rows of all folds that fit, tagged with their configuration; every fold tests the `test` rows before the next newer fold's.

    rows: symbol, date, rn (from 1), n (rows of the symbol), label (null on the newest `horizon` rows), features. Between train and test `horizon`
    rows are left out. With last_only, the one fold whose test rows are the newest, unlabelled ones.
    """
    configs = checked(configs, sets)
    test = horizon if last_only else test
    end = F.col("n") if last_only else F.col("n") - horizon  # of the newest fold's test rows
    back = end - F.col("rn")
    fits = (back - test - horizon == 0) if last_only else (back - test - horizon >= 0) & ((back - test - horizon) % test == 0)
    out = models(rows, fits, configs, sets)
    carried = F.last("made", ignorenulls=True).over(series().rowsBetween(-(2 * test + horizon), -(1 + horizon)))
    out = out.withColumn("made", carried).withColumn("run", F.floor(back / test).cast("int")).withColumn("test_days", F.lit(test))
    out = out.withColumn("test_end", F.min(F.when(back % test == 0, F.col("date"))).over(series().rowsBetween(0, test - 1)))
    out = out.where((back >= 0) & ((back < test) if last_only else F.lit(True))).withColumn("horizon", F.lit(horizon))
    return scored(out.withColumn("made", F.explode("made")), names_of(sets))


def grid_joined(rows: DataFrame, horizon: int, test: int, configs: list[Config], sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """run_grid with the configurations as a table: what windows carry is the same however many there are.

    A fold is one row: what its last train row knows, joined with the fold's test rows (at most `test`, one array) by symbol and run. Folds meet
    the configurations that have their train rows; only then are features chosen and test rows scored. Folds are dealt by symbol and run to a
    number of tasks, as adaptive execution would put these few bytes of much work into one; so one long symbol is many tasks from there on.
    """
    configs, names, back = checked(configs, sets), names_of(sets), F.col("n") - horizon - F.col("rn")
    ends = fitted(rows, (back - test - horizon >= 0) & ((back - test - horizon) % test == 0), configs, sets).where("__at")
    run = lambda ahead: F.floor((back - ahead) / test).cast("int").alias("run")
    ends = ends.select("symbol", run(test + horizon), "date", "rn", "firsts", "rates", "gains")
    days = rows.where(back >= 0).select("symbol", run(0), F.struct("date", "label", *names).alias("day"))
    days = days.groupBy(F.col("symbol").alias("__symbol"), F.col("run").alias("__run")).agg(F.collect_list("day").alias("days"), F.max("day.date").alias("test_end"))
    trains = sorted({c.train for c in configs})
    own = F.explode(F.filter(F.array(*[F.when(F.col("rn") >= w, F.lit(i)) for i, w in enumerate(trains)]), lambda i: i.isNotNull()))
    ends = ends.select("*", own.alias("train_at"))
    table = rows.sparkSession.range(1, numPartitions=1).select(F.explode(literal(configs, names, sets)).alias("c")).select("c", "c.train_at")
    met = F.col("symbol").eqNullSafe(F.col("__symbol")) & (F.col("run") == F.col("__run"))
    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    folds = ends.join(days, met).repartition(tasks, "symbol", "run").join(table, "train_at")
    found = folds.select("symbol", "run", "test_end", "days", made(F.col("c"), names).alias("made"))
    found = found.select("symbol", "run", "test_end", "made", F.explode("days").alias("day"))
    return scored(found.select("symbol", F.lit(horizon).alias("horizon"), "run", F.lit(test).alias("test_days"), "test_end", "made", "day.*"), names)


def score_pending(rows: DataFrame, history: DataFrame, horizon: int, configs: list[Config], sets: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """Predictions of the labelled days after each configuration's last as-of date, in one window per symbol; where they are more than `least`.

    history: predictions of one horizon. A configuration's model is fitted up to `horizon` rows before its first pending day.
    """
    configs, keys = checked(configs, sets), [k for k in KEYS if k != "horizon"]
    last = history.groupBy("symbol", *keys).agg(F.max("date").alias("last_date"))
    ends = last.join(rows.select("symbol", F.col("date").alias("last_date"), F.col("rn").alias("last_rn"), "n"), ["symbol", "last_date"])
    ends = ends.withColumn("pending", F.col("n") - horizon - F.col("last_rn")).where(F.col("pending") > least).drop("n").withColumn("fit_rn", F.col("last_rn") - horizon)
    need = ends.groupBy("symbol", F.col("fit_rn").alias("rn")).agg(F.min("last_rn").alias("low"))
    marked = rows.join(need.select("symbol", "rn", F.lit(True).alias("fit")), ["symbol", "rn"], "left").withColumn("fit", F.coalesce("fit", F.lit(False)))
    found = models(marked, F.col("fit"), configs, sets).where("made is not null").select("symbol", F.col("rn").alias("fit_rn"), F.explode("made").alias("made"))
    found = found.select("symbol", "fit_rn", "made", *[F.col(f"made.{k}").alias(k) for k in keys])
    fitted = ends.join(found, ["symbol", "fit_rn", *keys]).select("symbol", "last_rn", "pending", "made")
    days = rows.where("label is not null").join(need.groupBy("symbol").agg(F.min("low").alias("low")), "symbol").where("rn > low").drop("low")
    out = days.join(fitted, "symbol").where("rn > last_rn").withColumn("horizon", F.lit(horizon)).withColumn("run", F.lit(0)).withColumn("test_days", F.col("pending").cast("int"))
    newest = rows.where("label is not null").groupBy("symbol").agg(F.max("date").alias("test_end"))
    return scored(out.join(newest, "symbol"), names_of(sets))


def importance_rows(rows: DataFrame, horizon: int, test: int, c: Config, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """symbol, horizon, run, feature, pi_mean: the importance of every feature in every fold of a configuration, as a share of the rows it is taken from."""
    names, back = names_of(sets), F.col("n") - horizon - F.col("rn") - test - horizon
    out = counted(rows, names, {c.pi_rows}).where((back >= 0) & (back % test == 0) & (F.col("rn") >= c.train))
    gains = F.transform(importances(names, c.pi_rows), lambda g, i: F.struct(F.get(F.array(*[F.lit(n) for n in names]), i).alias("feature"), rnd(g / F.lit(float(c.pi_rows)), 6).alias("pi_mean")))
    return out.select("symbol", F.lit(horizon).alias("horizon"), F.floor(back / test).cast("int").alias("run"), F.inline(gains))


def chosen_features(rows: DataFrame, horizon: int, test: int, configs: list[Config], sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row for each fold, configuration and chosen feature."""
    back = F.col("n") - horizon - F.col("rn") - test - horizon
    found = models(rows, (back >= 0) & (back % test == 0), checked(configs, sets), sets).where("made is not null")
    found = found.select("symbol", F.lit(horizon).alias("horizon"), F.floor(back / test).cast("int").alias("run"), F.explode("made").alias("made"))
    keys = [F.col(f"made.{k}") for k in KEYS if k != "horizon"]
    names = F.array(*[F.lit(n) for n in names_of(sets)])
    return found.select("symbol", "horizon", "run", *keys, F.explode(F.transform("made.chosen", lambda i: F.get(names, i))).alias("feature"))
