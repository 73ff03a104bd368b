"""Places of rows within their keys, off a table in global order: no window over a key, so a key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, written


def numbered(df: DataFrame, key: str, by: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, keys): df's rows with size (rows of their key), nr (place among them, from 0, in order of `by`), key_nr (place of the key
    among all keys) and pos (place among all rows); and keys: key, size, key_nr, start (pos of its first row).

    df is range-sorted into a table whose files are numbered in its order; what is counted is one row per file and key.
    Nulls come first. Rows that agree in key and `by` are spread by a number of their own, so equal rows do not meet in one task either.
    """
    tied = written(df.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")
    table = written(tied.sort(key, *by, "tie").drop("tie"), f"{name}-sorted")
    at = table.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    spans = written(at.groupBy("file", key).agg(F.count("*").alias("n"), F.min("row").alias("first")), f"{name}-spans")
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = W.orderBy(number, "file").rowsBetween(W.unboundedPreceding, -1)  # as many rows as there are files
    files = spans.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    spans = spans.join(files, "file").withColumn("pos", F.col("before") + F.col("first"))
    keys = written(spans.groupBy(key).agg(F.sum("n").alias("size"), F.min("pos").alias("start"), F.min_by("file", "pos").alias("file")), f"{name}-starts")
    opened = keys.groupBy("file").count().select("file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("opened"))
    nr = F.row_number().over(W.partitionBy("file").orderBy("start")) - 1
    keys = written(keys.join(opened, "file").select(key, "size", "start", (F.col("opened") + nr).alias("key_nr")), f"{name}-keys")
    same = keys.select(F.col(key).alias("__same"), "size", "start", "key_nr")
    spans = spans.join(same, F.col(key).eqNullSafe(F.col("__same"))).select("file", key, "before", "size", "start", "key_nr")
    rows = attach(at, written(spans, f"{name}-places"), ["file", key]).withColumn("pos", F.col("before") + F.col("row"))
    return rows.withColumn("nr", F.col("pos") - F.col("start")).drop("file", "row", "before", "start"), keys
