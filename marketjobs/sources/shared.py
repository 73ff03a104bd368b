"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local mode gets a folder of its own, and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = made.get() if made.isDefined() else None
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_of(spark: SparkSession, name: str, *tables: str) -> str:
    """A folder for what is made from tables (Parquet paths), the same in a session as long as the tables' names, sizes and times are."""
    state = [spark.sparkContext.applicationId]
    for table in tables:
        fs, at = file_system(spark, table)
        state += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in (fs.listStatus(at) if fs.exists(at) else [])]
    return f"{shared_dir(spark)}/{name}-{hashlib.sha256(chr(10).join([*tables, *state]).encode()).hexdigest()[:32]}"


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path of `path_of`, made at the first call; one that broke off is made anew."""
    fs, done = file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written in the innermost scope.
SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those written with keep: for work whose result is such a table."""
    made: list[str] = []
    outer = SCOPE.set(made)
    try:
        yield
    finally:
        SCOPE.reset(outer)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: the lineage ends there and a lost executor takes nothing with it."""
    path = new_path(df.sparkSession, name)
    if not keep and (scope := SCOPE.get()) is not None:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
