"""What the operators share: reading tables, cutting lineage in the shared folder, joins behind a size check."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..sources.shared import new_path, scratch, shared_dir, written
from ..sources.tables import read

__all__ = ["attach", "is_small", "new_path", "packed", "read", "scratch", "shared_dir", "short_plans", "small_batches", "unpacked", "words", "written"]

#: White space between words; a word is everything else. Fixed values.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


#: A side is broadcast up to so many bytes of its values.
BROADCAST_BYTES = 8 << 20


def value_bytes(x: Column, kind: DataType) -> Column:
    """Bytes of a value: eight for numbers and the like, all the bytes of strings, and what is in arrays and structs."""
    if isinstance(kind, StringType | BinaryType):
        size = F.octet_length(x)
    elif isinstance(kind, StructType):
        size = reduce(lambda a, b: a + b, [value_bytes(x[f.name], f.dataType) for f in kind], F.lit(0))
    elif isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | StructType | ArrayType):
            size = F.aggregate(x, F.lit(0).cast("long"), lambda n, v: n + value_bytes(v, kind.elementType))
        else:
            size = F.size(x) * 8
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long") + 16


def is_small(side: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table, which should be a written one as it is read for this, has at most so many bytes."""
    size = reduce(lambda a, b: a + b, [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in side.schema])
    return (side.agg(F.sum(size)).first()[0] or 0) <= max_bytes


def attach(df: DataFrame, side: DataFrame, on: list[str], how: str = "left", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Null-safe join with `side`, a written table with unique keys: broadcast if its counted bytes are few, else shuffled (adaptive execution splits hot keys).

    The shuffle is asked for by a hint: Spark goes by the bytes of Parquet files, which are far fewer than those of their rows, and would broadcast either side.
    """
    keys = {k: f"__{k}" for k in on}
    right = side.withColumnsRenamed(keys)
    right = F.broadcast(right) if is_small(side, max_bytes) else right.hint("merge")
    cond = reduce(lambda a, b: a & b, (df[k].eqNullSafe(right[v]) for k, v in keys.items()))
    return df.join(right, cond, how).drop(*keys.values())


#: Bytes of a batch that goes to a Python worker, for operators that hold several things of a batch's size.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Limits Arrow batches for what is executed inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Plans executed inside are kept as short texts: of a list of columns the first only, so that large literals in others are not written out; the session's own settings come back afterwards."""
    short = {"spark.sql.ui.explainMode": "simple", "spark.sql.debug.maxToStringFields": "1"}
    before = {name: spark.conf.get(name) for name in short}
    for name, value in short.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def packed(df: DataFrame) -> DataFrame:
    """df with all its columns in one struct, __row: whatever else an operator adds cannot clash with their names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def unpacked(df: DataFrame, *more: str, **changed: Column) -> DataFrame:
    """The columns of __row, some changed, without those that `more`, columns of df, take the place of."""
    names = df.schema["__row"].dataType.names
    own = [changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in names if c not in more]
    return df.select(*own, *more)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and for blank texts."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
