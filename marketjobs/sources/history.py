"""The stored history of predictions: runs are written apart and count once they are marked as whole.

`rows/batch=<run>/horizon=<h>/` holds the rows of a run, `whole/<run>`, with their schema, is made when all of them are there. Readers see marked runs only.
A run that broke off is written anew under its name, and a run that is whole already is left as it is, so a retry changes nothing.
Runs of different names may be appended at the same time; one of a name at a time.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import file_system


def runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole runs, in order: one for each append, not one for each row."""
    fs, at = file_system(spark, f"{path}/whole")
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def append(predictions: DataFrame, path: str, run: str) -> bool:
    """Adds predictions as a run, unless that is whole already; whether it did."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", run):
        raise ValueError(f"letters, digits and hyphens only in the name of a run: {run!r}")
    spark = predictions.sparkSession
    if run in runs(spark, path):
        return False
    predictions.write.mode("overwrite").partitionBy("horizon").parquet(f"{path}/rows/batch={run}")
    fs, at = file_system(spark, f"{path}/whole/{run}")
    out = fs.create(at, True)
    out.write(predictions.schema.json().encode())
    out.close()
    return True


def schema_of(spark: SparkSession, path: str, run: str) -> StructType:
    fs, at = file_system(spark, f"{path}/whole/{run}")
    stream = fs.open(at)
    try:
        return StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def load(spark: SparkSession, path: str, schema: StructType | None = None, horizon: int | None = None) -> DataFrame:
    """The rows of all whole runs, or those of one horizon (only its partitions are read). Without a schema, that of the first run is taken; with one,
    a history that stores nothing yet is empty."""
    whole = runs(spark, path)
    if not whole:
        if schema is None:
            raise FileNotFoundError(f"no whole run in {path}")
        return spark.createDataFrame([], schema)
    schema = schema or schema_of(spark, path, whole[0])
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={run}" for run in whole])
    rows = rows.select(*schema.names)
    return rows if horizon is None else rows.where(F.col("horizon") == horizon)


def checked_times(rows: DataFrame, column: str) -> DataFrame:
    """rows with the text column as a timestamp; raises with their number if some cannot be read."""
    out = rows.withColumn(column, F.try_to_timestamp(F.col(column)))
    bad = out.agg(F.count_if(F.col(column).isNull())).first()[0]
    if bad:
        raise ValueError(f"{bad} rows without a readable time in {column}")
    return out
