"""The corpus pipeline: quality rules, near-duplicates, secrets, the mix of sources, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
documents. `run` writes each stage's result to the shared folder and reads it again for the next.

Defined results: an empty table passes through every stage; further columns, whatever their names, go with
their rows until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketjobs.llm import bpe, mixing, near, quality, secrets
from marketjobs.llm.common import attach, new_path, packed, read, short_plans, small_batches, unpacked, written


def keyed(docs: DataFrame) -> DataFrame:
    """Rows of docs as __row, with doc_id, source and a hash of the text to join on."""
    return packed(docs).select("__row", F.col("__row.doc_id").alias("doc_id"), F.col("__row.source").alias("source"), F.xxhash64("__row.text").alias("th"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the rules and whose host is not rejected."""
    judged = quality.judged(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("th")), ["doc_id", "source", "th"])
    gone = written(judged.where(~F.col("kept")).select("doc_id", "source", "th").distinct(), "gone")
    return unpacked(attach(keyed(docs), gone, ["doc_id", "source", "th"], "left_anti"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity of at least 0.8): the one with the smallest id.

    SimHash fingerprints in a Gray-ordered index give candidates, which are verified exactly; prefix filters find the links beyond its radius.
    """
    return near.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets in their texts give way to the name of their kind. n_chars follows."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, range-sorted by training position. The first of repeated rows stands for all of them.

    Places are a row each and as many as documents, so they are never broadcast: a text moves once to its place and once to its position.
    """
    keys = ["doc_id", "source", "th"]
    mixed = written(mixing.mix(docs).select(*keys, "positions"), "mix-positions")
    again = written(mixed.groupBy(*keys).count().where("count > 1").select(*keys, F.lit(True).alias("again")), "mix-again")
    rows = attach(keyed(docs), again, keys)
    rows = rows.where("again is null").unionByName(rows.where("again").dropDuplicates(keys)).select("__row", *keys)
    places = written(mixed.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.explode("positions").alias("position")), "mix-places")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    return unpacked(rows.join(places, same).sort("position", "doc_id"))


def ordered(docs: DataFrame) -> DataFrame:
    """docs, read from a sorted table, with __position: the place of each row in the order of the table, from 0. Spark numbers the files of a table in its order."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    number = F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = F.coalesce(F.sum("count").over(Window.orderBy(number, "__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = written(rows.groupBy("__file").count().select("__file", before.alias("__first")), "pipeline-files")
    return attach(rows, first, ["__file"]).withColumn("__position", F.col("__first") + F.col("__at"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position (of training, from 0), doc_id, n_tokens and the ids of each document of the mix, for each of its copies."""
    with small_batches(spark), short_plans(spark):  # the rank map is in the plan: 15 MB as text, several times
        rows = bpe.encoded(ordered(docs), key=F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("__position").alias("position")))
        return written(rows.select("doc_id.position", "doc_id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"), "pipeline-ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixed_sources", mixed_sources),
    ("token_ids", token_ids),
]

#: SQL has no XXH64 and no byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
