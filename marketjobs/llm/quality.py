"""Quality rules on documents and, from their failures, on hosts (DataFrame functions only).

Each document is measured over its whole text. A host's failure rate is shrunk towards the rate of all hosts with a beta
prior whose strength is fitted to the spread of the hosts' rates (moments); hosts whose shrunk rate is above a limit are
rejected whole, and the verdict is joined back to their documents.

Defined results: null and empty texts have no words and fail; a null host is a host of its own; repeated rows count as often
as they occur; an empty table gives an empty result; other columns of the input are
kept under their names by `judged`, unless a column of its result has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, read, unpacked, words, written

MIN_WORDS, MAX_REPEATED = 50, 50
#: A host falls if its shrunk share of failing documents is above this.
HOST_LIMIT = 0.8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(windows: Column, width: int) -> Column:
    """How many words lie in a window found twice or more. windows: (hash, place) of each window, sorted, so that equal windows are neighbours.

    The places next to an equal window, in order, cover min(width, distance to the one before) words each.
    """
    hash_at = lambda i: F.get(windows, i)["h"]
    twice = lambda x, i: F.coalesce(hash_at(i + 1) == x["h"], F.lit(False)) | F.when(i > 0, hash_at(i - 1) == x["h"]).otherwise(False)
    places = F.sort_array(F.transform(F.filter(windows, twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last"))
    return F.aggregate(places, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(width).cast("long"), x - a["last"])).alias("n"), x.cast("long").alias("last")), lambda a: a["n"])


def measured(df: DataFrame, width: int = 3) -> DataFrame:
    """df with the columns of MEASURES for its column text."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    out = df.withColumn("__w", words(F.col("text"))).withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("word_chars", F.char_length(F.array_join("__w", "")).cast("long"))
    out = out.withColumn("n_symbols", F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"))
    out = out.withColumn("__l", lines).withColumn("n_dup_lines", F.coalesce(F.size("__l") - F.size(F.array_distinct("__l")), F.lit(0)).cast("long"))
    window = lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(width)])
    out = out.withColumn("__g", F.when(F.col("n_words") >= width, F.transform(F.sequence(F.lit(0), F.size("__w") - width), window)).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("__g")) < F.size("__g")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("__p", F.when(twice, F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    out = out.withColumn("n_repeat_words", repeated_words(F.col("__p"), width))
    return out.drop("__w", "__l", "__g", "__p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def host_rates(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """One row per host: n, fails, rate shrunk with the fitted beta prior, rejected.

    Mean m and variance v of the hosts' rates give the prior's strength m (1 - m) / v - 1, v less the sampling variance,
    kept within 1 and 1000 documents; the sums for it are one row, joined to the hosts.
    """
    hosts = rows.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("fails"))
    rate = F.col("fails") / F.col("n")
    fit = hosts.agg(F.sum("fails").alias("f"), F.sum("n").alias("t"), F.count("*").alias("h"), F.sum(rate).alias("s"), F.sum(rate * rate).alias("q"), F.sum(1.0 / F.col("n")).alias("r"))
    m, mean = F.try_divide(F.col("f"), F.col("t")), F.try_divide(F.col("s"), F.col("h"))
    fit = fit.select(m.alias("m"), (F.try_divide(F.col("q"), F.col("h")) - mean * mean - m * (1 - m) * F.try_divide(F.col("r"), F.col("h"))).alias("v"))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(1000.0)))
    shrunk = (F.col("fails") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    out = hosts.crossJoin(F.broadcast(fit.select("m", strength.alias("strength")))).withColumn("host_rate", shrunk)
    return out.select(host, F.col("n").alias("host_docs"), F.col("fails").alias("host_fails"), "host_rate", (F.col("host_rate") > HOST_LIMIT).alias("host_rejected"))


def judged(docs: DataFrame, keep: list[str], host: str = "source") -> DataFrame:
    """Columns `keep` of docs with MEASURES, base_failed, the host's figures and kept, which take the place of columns of their names.
    The measures are written once (narrow if `keep` is)."""
    own = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(keep)]).alias("__row")
    rows = measured(docs.select(own, F.col(f"`{host}`").alias("__host"), "text")).withColumn("base_failed", base_failed())
    rows = written(rows.select("__row", "__host", *MEASURES, "base_failed"), "quality")
    hosts = written(host_rates(rows, "__host", "base_failed"), "quality-hosts")
    out = attach(rows, hosts, ["__host"]).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return unpacked(out, *MEASURES, "base_failed", "host_docs", "host_fails", "host_rate", "host_rejected", "kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents"), ["doc_id", "source"])
    return out.select("doc_id", *MEASURES, "base_failed", "kept", "source", F.round("host_rate", 9).alias("host_rate"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT u, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT u, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT u, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 3)) AS r(k) GROUP BY u),
l AS (SELECT u, count(*) - count(DISTINCT x) AS n FROM (SELECT u, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY u),
m AS (
  SELECT w.u, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (u) LEFT JOIN l USING (u)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS fails FROM b GROUP BY source),
s AS (
  SELECT sum(fails)::DOUBLE / sum(n) AS m, avg(fails::DOUBLE / n) AS a, avg((fails::DOUBLE / n) * (fails::DOUBLE / n)) AS q, avg(1.0::DOUBLE / n) AS r FROM h),
p AS (SELECT m, q - a * a - m * (1 - m) * r AS v FROM s),
k AS (SELECT m, greatest(1.0::DOUBLE, least(1000.0::DOUBLE, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000 END)) AS strength FROM p),
r AS (SELECT source, (fails + m * strength) / (n + strength) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > 0.8 AS kept, b.source, round(rate, 9) AS host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
