"""Secret scans with multipart credential linking (DataFrame functions only).

Strong kinds are reported wherever they are found: `assign` (a name like password, a sign, a value), `access` (access
identifiers) and `hex` (long hexadecimal strings). Weak kinds alone mean nothing and are reported only if complementary
parts lie within a scope of so many code points: `ident` (short or named identifiers) next to a secret, `key` (mixed
random-looking strings) next to an identifier, `endpoint` (service addresses) next to an identifier and a secret. Weak
parts that overlap a strong one are not reported a second time.

Regex functions give no places, so a text is split at the matches: the lengths of gaps and matches, summed up in order,
are the places. The interval join is an equality join on bins as wide as the scope: per text and bin the first and last
place of identifiers and secrets decide whether one lies in reach, so its rows grow with the parts and not with their pairs.

Defined results: null and empty texts have no spans; a repeated row is scanned once and gets the same spans; texts are
told apart by (doc_id, hash of the text), so tied ids are no problem; an empty table gives an empty result; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, packed, read, unpacked, written

#: Kinds in the order of reports, with their patterns. Fixed values.
STRONG = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
WEAK = (
    ("ident", r"""(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{4,}|(?i:client_id|key_id|account_id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""),
    ("key", r"[A-Za-z0-9+/]{20,}={0,2}"),
    ("endpoint", r"""(?:https?|s3|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""),
)
KINDS = tuple(k for k, _ in STRONG + WEAK)
MIN_VALUE, MIN_ACCESS, MIN_HEX, SCOPE = 6, 20, 24, 500
#: hex runs are found as such: runs shorter than MIN_HEX can hold no longer one, so the pattern can ask for the length.
HEX = r"[0-9a-f]{%d,}" % MIN_HEX
IDS, SECRETS = ("access", "ident"), ("assign", "hex", "key")


def places(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, i, gap, len, ok) of the non-overlapping matches, leftmost first; gap: code points since the match before."""
    pattern = HEX if kind == "hex" else pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g"), *([F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v")] if kind == "assign" else []))

    def part(x: Column, i: Column) -> Column:
        m = x["m"]
        ok = {
            "assign": lambda: F.char_length(x["v"]) >= MIN_VALUE,
            "access": lambda: F.char_length(m) >= MIN_ACCESS,
            "key": lambda: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"),
        }.get(kind, lambda: F.lit(True))()
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.char_length(x["g"]).alias("gap"), F.char_length(m).alias("len"), ok.alias("ok"))

    cheap = F.contains(text, F.lit("AKIA")) if kind == "access" else F.contains(text, F.lit("://")) if kind == "endpoint" else text.rlike(pattern)
    return F.when(cheap, F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), part)).otherwise(F.array())


def parts(docs: DataFrame) -> DataFrame:
    """One row per part found: doc_id, th (hash of the text), kind, start, end; written once, as the texts are read for it."""
    found = F.concat(*[places(F.col("text"), k, p) for k, p in STRONG + WEAK])
    scanned = written(docs.select("doc_id", F.xxhash64("text").alias("th"), found.alias("parts")).where(F.size("parts") > 0), "secret-parts")
    rows = scanned.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.inline("parts"))
    upto = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("doc_id", "th", "kind").orderBy("i"))
    rows = rows.withColumn("end", upto).withColumn("start", F.col("end") - F.col("len")).where("ok")
    strong = F.col("kind") < len(STRONG)
    near = W.partitionBy("doc_id", "th").orderBy("start", "kind")
    before = F.max(F.when(strong, F.col("end"))).over(near.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(strong, F.col("start"))).over(near.rowsBetween(1, W.unboundedFollowing))
    over = ~strong & (F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    return rows.withColumn("over", over).where(~F.col("over")).select("doc_id", "th", "kind", "start", "end")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong parts, and the weak ones whose complementary parts start within `scope` code points."""
    number = lambda names: [KINDS.index(k) for k in names]
    is_id, is_secret = F.col("kind").isin(number(IDS)), F.col("kind").isin(number(SECRETS))
    binned = found.withColumn("bin", F.floor(F.col("start") / scope))
    ends = lambda what, name: [f(F.when(what, F.col("start"))).alias(f"{name}_{f.__name__}") for f in (F.min, F.max)]
    summary = binned.where(is_id | is_secret).groupBy("doc_id", "th", "bin").agg(*ends(is_id, "id"), *ends(is_secret, "secret"))
    weak = binned.where(F.col("kind") >= len(STRONG)).select("doc_id", "th", "kind", "start", "end", F.explode(F.array(*[F.struct(F.lit(d).alias("off"), (F.col("bin") + d).alias("bin")) for d in (-1, 0, 1)])).alias("near"))
    weak = weak.select("doc_id", "th", "kind", "start", "end", "near.off", "near.bin").join(summary.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t").withColumnRenamed("bin", "b"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("bin") == F.col("b")))

    def reach(name: str) -> Column:
        hit = F.when(F.col("off") == 0, F.col(f"{name}_min").isNotNull()).when(F.col("off") < 0, F.col(f"{name}_max") >= F.col("start") - scope).otherwise(F.col(f"{name}_min") <= F.col("start") + scope)
        return F.coalesce(F.bool_or(hit), F.lit(False))

    weak = weak.groupBy("doc_id", "th", "kind", "start", "end").agg(reach("id").alias("by_id"), reach("secret").alias("by_secret"))
    fits = F.when(F.col("kind") == KINDS.index("ident"), F.col("by_secret")).when(F.col("kind") == KINDS.index("key"), F.col("by_id")).otherwise(F.col("by_id") & F.col("by_secret"))
    return found.where(F.col("kind") < len(STRONG)).unionByName(weak.where(fits).select("doc_id", "th", "kind", "start", "end"))


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per (doc_id, th) that has spans: spans, an array of (start, kind, end) in order. Written, so that it can be counted and joined."""
    rows = linked(written(parts(docs), "secret-places"), scope)
    return written(rows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")), "secret-spans")


def named(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets, overlapping spans by one; the other columns, and texts without spans, as they are."""
    keyed = packed(docs).select("__row", F.col("__row.doc_id").alias("doc_id"), F.col("__row.text").alias("text"), F.xxhash64("__row.text").alias("th"))
    joined = attach(keyed, spans(docs.select("doc_id", "text"), scope), ["doc_id", "th"])
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    merged = F.aggregate("spans", none, lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] > s["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.element_at(a, -1)["kind"].alias("kind"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(F.struct(s["start"].cast("bigint").alias("start"), s["kind"].alias("kind"), s["end"].cast("bigint").alias("end"))))))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    joined = joined.withColumn("spans", F.when(F.size("spans") > 0, merged))
    at = lambda i: F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(F.lit(0).cast("bigint"))
    pieces = F.transform("spans", lambda s, i: F.concat(F.substr(F.col("text"), (at(i) + 1).cast("int"), (s["start"] - at(i)).cast("int")), F.element_at(names, s["kind"] + 1)))
    rest = F.substr(F.col("text"), (F.element_at("spans", -1)["end"] + 1).cast("int"))
    return unpacked(joined, text=F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = attach(keyed, spans(docs), ["doc_id", "th"])
    none = F.coalesce(F.col("spans"), F.array().cast(dict(out.dtypes)["spans"]))
    base = F.filter("spans", lambda s: s["kind"] < len(STRONG))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.withColumn("spans", none).select("doc_id", *[count(k) for k in range(len(STRONG))], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
