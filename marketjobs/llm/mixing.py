"""Mixing sources to target weights with a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time 0..1, a piecewise linear curve given by its values at equidistant
knots. The integral of the curve is the source's weight: it fixes how many words the mix takes of the source. The curve
itself fixes when: the words a source gives up to time t follow the integral up to t, so inverting that integral turns a
document's place in its source's running word count into a training position. Sorting by position gives the mix.

Defined results: null text has size 0; a null source is a source of its own, after all others; rows repeated or with tied
ids are taken as separate rows, ordered by (hash of id and text, id, size); an empty table gives an empty mix; a source without words has
target 0; columns other than doc_id, source and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, attach, read, written

#: Weight schedules, dealt to the sources in turn; they integrate to 3, 1 and 2: early, even, late.
SCHEDULES = ((4.0, 3.0, 2.0), (1.0, 1.0, 1.0), (1.0, 2.0, 3.0))
SHARE, CAP = 1.5, 2.0
#: Documents of a source are ordered by a hash of their id and text, cut into bins of so many documents of the whole table each.
BIN_ROWS = 20_000


def integral(schedule: tuple[float, ...]) -> float:
    return sum((a + b) / 2 for a, b in zip(schedule, schedule[1:], strict=False)) / (len(schedule) - 1)


def inverse(schedule: tuple[float, ...], share: Column) -> Column:
    """The time by which the schedule has given `share` (0..1) of its integral."""
    k = len(schedule) - 1
    need, done, out = share * F.lit(integral(schedule)), 0.0, None
    for i, (a, b) in enumerate(zip(schedule, schedule[1:], strict=False)):
        rest = need - F.lit(done)
        slope = (b - a) * k
        t = F.lit(i / k) + F.lit(2.0) * rest / (F.lit(a) + F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2 * slope) * rest)))
        done += (a + b) / 2 / k
        out = F.when(need <= F.lit(done), t) if out is None else out.when(need <= F.lit(done), t) if i < k - 1 else out.otherwise(t)
    return out if k > 1 else F.coalesce(out, F.lit(1.0))


def targets(sources: DataFrame, schedules=SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with turn (index of the schedule) and target.

    Water filling in closed form: sources in order of cap * size / weight fill up first; the level left for the others is
    (demand - what the full ones take) / (weights of the others). One row per source, so the windows are over few rows.
    """
    weight = F.element_at(F.lit([integral(s) for s in schedules]), F.col("turn") + 1)
    full = W.orderBy("fills_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("turn", ((F.col("rank") - 1) % len(schedules)).cast("int")).withColumn("weight", weight)
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(full), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    last = F.coalesce(F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(every), F.max("fills_at").over(every))
    return ranked.withColumn("target", F.least("most", last * F.col("weight"))).select("source", "source_size", "turn", "target")


def order_key(doc_id: Column, text: Column) -> Column:
    """Hash of a document's id and text, by which those of a source are ordered and cut into bins: rows of one or no id are spread too."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, cap: float = CAP, bin_rows: int = BIN_ROWS) -> DataFrame:
    """One row per document: doc_id, source, th (hash of the text), size, source_size, target, copies, taken, position (of the first copy, null if none), positions (of all copies).

    A document's place is the running word count of its source in hash order: sums per bin of hash prefixes, a running sum
    over the bins, and a running sum inside each bin; no task sees a whole source. Whole passes over the source come first;
    of the rest of the target, documents are taken while their middle lies within it.
    """
    sized = written(
        docs.select("doc_id", "source", F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("order_key")), "mix-sizes"
    )
    rows = sized.count()
    digits = max(2, math.ceil(math.log(max(rows, 1) / bin_rows, 16))) if rows else 2
    sized = sized.withColumn("bin", F.substring("order_key", 1, digits))
    bins = written(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    sources = written(targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), schedules, share, cap), "mix-targets")
    before = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = written(bins.select("source", "bin", F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("bin_start")), "mix-starts")
    inside = W.partitionBy("source", "bin").orderBy("order_key", "doc_id", "size", "th").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = attach(attach(placed, starts, ["source", "bin"]), sources, ["source"])
    place, size, whole = F.col("bin_start") + F.col("inside"), F.col("size"), F.col("source_size")
    passes = F.when(whole > 0, F.floor(F.col("target") / whole)).otherwise(0).cast("long")
    placed = placed.withColumn("place", place).withColumn("passes", passes)
    rest = F.col("target") - F.col("passes") * whole
    copies = F.when(size > 0, F.col("passes") + F.when((F.col("place") * 2 + size) < rest * 2, 1).otherwise(0)).otherwise(0)
    placed = placed.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * size)

    def at(copy: Column) -> Column:
        share_of = (copy * whole + F.col("place") + size / F.lit(2.0)) / F.col("target")
        out = F.when(F.col("turn") == 0, inverse(schedules[0], share_of))
        for i, s in enumerate(schedules[1:], 1):
            out = out.when(F.col("turn") == i, inverse(s, share_of))
        return F.least(F.lit(1.0), out)

    placed = placed.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>")))
    placed = placed.withColumn("position", F.get("positions", F.lit(0)))
    return placed.select("doc_id", "source", "th", "size", "source_size", "target", "copies", "taken", "position", "positions")


def ordered(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; documents that the mix leaves out come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id", "size")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return ordered(mixed).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per),
w AS (SELECT *, CASE turn WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM ranked),
f AS (SELECT *, most / weight AS fills_at FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM f WINDOW p AS (ORDER BY fills_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, turn,
    least(most, coalesce(max(CASE WHEN level <= fills_at THEN level END) OVER (), max(fills_at) OVER ()) * weight) AS target
  FROM l),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.turn,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS passes
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN size > 0 THEN passes + CASE WHEN place * 2 + size < (target - passes * source_size) * 2 THEN 1 ELSE 0 END ELSE 0 END AS copies
  FROM placed),
shared AS (SELECT *, (place + size / 2.0::DOUBLE) / target AS u FROM taken)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(least(1.0, CASE turn
    WHEN 0 THEN CASE WHEN u * 3 <= 1.75 THEN 2 * (u * 3) / (4 + sqrt(greatest(0, 16 - 4 * (u * 3)))) ELSE 0.5 + 2 * (u * 3 - 1.75) / (3 + sqrt(greatest(0, 9 - 4 * (u * 3 - 1.75)))) END
    WHEN 1 THEN u
    ELSE CASE WHEN u * 2 <= 0.75 THEN 2 * (u * 2) / (1 + sqrt(greatest(0, 1 + 4 * (u * 2)))) ELSE 0.5 + 2 * (u * 2 - 0.75) / (2 + sqrt(greatest(0, 4 + 4 * (u * 2 - 0.75)))) END
  END), 6) END AS position
FROM shared
"""
