"""Extendible hashing into shards of limited size.

A directory is indexed by the leading bits of a hash of the document id. A bucket whose bytes exceed the limit splits on
the next bit; the others stay. The splits of many bits are found at once: bytes are summed per prefix of `depth` bits and
from there up to all shorter prefixes, and a bucket's depth is the first at which it fits. Only what still exceeds the
limit at that depth goes into another round of longer prefixes, so rounds number at most a few.

Rows with equal hashes (repeated or null ids) cannot be told apart by bits. If they are too many for a shard they go to overflow
parts by size: those of at most 2^c bytes and more than half of that share parts of limit / 2^c rows, so a part is within the limit,
and half full but for the last of its class. A row's part follows from its number among the rows of its size; these are numbered within
pieces of the table, so no task sees all of them.

Defined results: null texts have 0 bytes; a document above the limit is a shard of its own; an empty table has no shards; other columns
are kept by `sharded`, but for shard and overflow, which it adds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, packed, read, unpacked, written

LIMIT = 16 << 20
#: The query's limit: small, so that its buckets split on small tables too.
QUERY_LIMIT = 256 << 10
HASH_BITS = 60


def key(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, bits: int | Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - bits).cast("int"))


def directory(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """(cell, depth, shard_bytes, shard_docs) for each prefix of `depth` bits (cell) in rows; depth null where no bucket fits yet."""
    cells = written(rows.groupBy(prefix(F.col("h"), depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "shard-cells")
    up = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    up = up.withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")))
    buckets = up.groupBy("depth", "bucket").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fit = written(buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)), "shard-buckets")
    found = attach(up.select("cell", "depth", "bucket"), fit, ["depth", "bucket"], "inner").select("cell", F.struct("depth", "shard_bytes", "shard_docs").alias("at"))
    none = cells.select("cell", F.lit(None).cast(found.schema["at"].dataType).alias("at"))
    return written(found.unionByName(none).groupBy("cell").agg(F.min("at").alias("at")).select("cell", "at.*"), "shard-directory")


def part_sizes(rows: DataFrame, limit: int) -> DataFrame:
    """(h, n_bytes, first, ahead, per_part) of rows (h, n_bytes): the row numbered nr of its size is in part first + (ahead + nr) / per_part."""
    bits = F.when(F.col("n_bytes") <= 1, 0).otherwise(F.length(F.bin(F.col("n_bytes") - 1)))
    sizes = rows.groupBy("h", "n_bytes").agg(F.count("*").alias("n")).withColumn("bits", bits)
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(before("h", "bits", "n_bytes")), F.lit(0)))
    per_part = F.greatest(F.lit(1).cast("long"), F.expr(f"{limit}L div shiftleft(1L, bits)"))
    sizes = sizes.withColumn("per_part", F.when(F.col("bits") < 62, per_part).otherwise(1))
    classes = sizes.groupBy("h", "bits").agg(F.ceil(F.sum("n") / F.first("per_part")).alias("parts"))
    classes = classes.select("h", "bits", F.coalesce(F.sum("parts").over(before("h", "bits")), F.lit(0)).alias("first"))
    return written(sizes.join(classes.hint("merge"), ["h", "bits"]).select("h", "n_bytes", "first", "ahead", "per_part"), "shard-sizes")


def in_parts(rows: DataFrame, limit: int) -> DataFrame:
    """rows (h, n_bytes, piece, others), written, with overflow; for hashes whose rows are too many for one shard."""
    same = ["h", "n_bytes"]
    pieces = rows.groupBy(*same, "piece").agg(F.count("*").alias("n"))
    before = W.partitionBy(*same).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = written(pieces.select(*same, "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("piece_start")), "shard-pieces")
    nr = F.row_number().over(W.partitionBy(*same, "piece").orderBy(F.lit(1))) - 1
    out = attach(rows.withColumn("nr", nr), pieces, [*same, "piece"]).withColumn("nr", F.col("nr") + F.col("piece_start"))
    out = attach(out, part_sizes(rows, limit), same)
    overflow = F.expr("first + (ahead + nr) div per_part").cast("long")
    return out.withColumn("overflow", overflow).drop("nr", "piece_start", "first", "ahead", "per_part")


def overflow_parts(rows: DataFrame, limit: int) -> DataFrame:
    """in_parts with shard_bytes and shard_docs."""
    out = written(in_parts(rows, limit), "shard-overflow")
    sums = written(out.groupBy("h", "overflow").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs")), "shard-overflow-sums")
    return attach(out.drop("shard_bytes", "shard_docs"), sums, ["h", "overflow"])


def placed(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows (h, n_bytes, piece, others), written, with depth, shard (the bucket's bits), overflow, shard_bytes and shard_docs. piece: the part of the table that a row is in, of any kind."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, out, left = min(HASH_BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 3)), None, rows
    while True:
        table = directory(left, limit, depth)
        done = attach(left.withColumn("cell", prefix(F.col("h"), depth)), table, ["cell"], "inner")
        fits = done.where(F.col("depth").isNotNull()).withColumn("overflow", F.lit(0).cast("long"))
        out = fits if out is None else out.unionByName(fits)
        if table.where(F.col("depth").isNull()).isEmpty():
            break
        left = written(done.where(F.col("depth").isNull()).select(*rows.columns), "shard-left")
        if depth == HASH_BITS:  # what does not fit now has one hash
            out = out.unionByName(overflow_parts(left, limit).withColumn("depth", F.lit(HASH_BITS)).withColumn("cell", F.col("h")))
            break
        depth = min(HASH_BITS, depth + 8)
    bits = F.when(F.col("depth") > 0, F.lpad(F.bin(prefix(F.col("h"), F.col("depth"))), F.col("depth"), F.lit("0"))).otherwise(F.lit(""))
    return out.withColumn("shard", bits).drop("cell")


def hashed(size: Column) -> list[Column]:
    """Columns h, n_bytes and piece of documents."""
    return [key(F.col("doc_id")).alias("h"), size.alias("n_bytes"), F.spark_partition_id().alias("piece")]


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with shard (bits) and overflow. Rows of hashes with several parts, which cannot be joined by id, are written once with a number of their own."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    table = placed(written(docs.select("doc_id", *hashed(size)), "shard-rows"), limit)
    shards = written(table.groupBy("h").agg(F.first("shard").alias("shard"), F.max("overflow").alias("most")), "shard-of")
    keyed = packed(docs).select("__row", key(F.col("__row.doc_id")).alias("h"), F.coalesce(F.octet_length("__row.text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = attach(keyed, shards, ["h"])
    one = found.where("most = 0").select("__row", "shard", F.lit(0).cast("long").alias("overflow"))
    several = written(found.where("most > 0").select("__row", "h", "n_bytes", "shard", F.monotonically_increasing_id().alias("nr"), F.spark_partition_id().alias("piece")), "shard-several")
    parts = written(in_parts(several.select("h", "n_bytes", "piece", F.col("nr").alias("of")), limit).select(F.col("of").alias("nr"), "overflow"), "shard-parts")
    return unpacked(one.unionByName(attach(several, parts, ["nr"]).select("__row", "shard", "overflow")), "shard", "overflow")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """One folder per shard; rows of a shard are brought together first, so it is one file as long as Spark reads it whole."""
    sharded(docs, limit).repartition("shard", "overflow").write.partitionBy("shard", "overflow").parquet(path)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = written(read(spark, sf_dir, "documents").select("doc_id", *hashed(size)), "shard-rows")
    return placed(rows, QUERY_LIMIT).select("doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "overflow", "shard_bytes", "shard_docs")


OP4_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT u, doc_id, n_bytes, h, depth, h >> (60 - depth) AS bucket FROM d, unnest(range(0, 61)) AS r(depth)),
s AS (SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs FROM b WINDOW w AS (PARTITION BY depth, bucket)),
f AS (SELECT u, min(CASE WHEN shard_bytes <= 262144 OR shard_docs = 1 THEN depth END) AS depth FROM s GROUP BY u),
z AS (SELECT u, h, n_bytes, CASE WHEN n_bytes <= 1 THEN 0 ELSE length(bin(n_bytes - 1)) END AS bits FROM d JOIN f USING (u) WHERE depth IS NULL),
y AS (SELECT *, greatest(1, 262144 // (1::BIGINT << bits)) AS per_part, row_number() OVER (PARTITION BY h, bits ORDER BY n_bytes, u) - 1 AS nr FROM z),
c AS (SELECT h, bits, sum(ceil(count(*)::DOUBLE / any_value(per_part))) OVER (PARTITION BY h ORDER BY bits) - ceil(count(*)::DOUBLE / any_value(per_part)) AS start FROM y GROUP BY h, bits),
o AS (SELECT u, y.h, n_bytes, start::BIGINT + nr // per_part AS overflow FROM y JOIN c ON c.h = y.h AND c.bits = y.bits),
p AS (SELECT u, overflow, sum(n_bytes) OVER (PARTITION BY h, overflow) AS shard_bytes, count(*) OVER (PARTITION BY h, overflow) AS shard_docs FROM o),
a AS (
  SELECT u, doc_id, n_bytes, h, depth, 0::BIGINT AS overflow, shard_bytes, shard_docs FROM s JOIN f USING (u, depth)
  UNION ALL SELECT u, doc_id, n_bytes, h, 60, overflow, shard_bytes, shard_docs FROM d JOIN p USING (u))
SELECT doc_id, n_bytes, CASE WHEN depth > 0 THEN substr(lpad(bin(h), 60, '0'), 1, depth::INT) ELSE '' END AS shard, depth::INT AS depth, overflow, shard_bytes::BIGINT AS shard_bytes, shard_docs FROM a
"""
