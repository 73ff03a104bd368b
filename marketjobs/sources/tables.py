"""Reading the input tables, and binding them to the schemas of bars, context, minutes and calendar.

Prices are whole cents, so sums over them are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close (cents), volume: the orders of a priority and day; line items are summed per order before the join."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    sold = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    rows = orders.join(sold, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("symbol", "date").agg(
        F.min_by("cents", "o_orderkey").alias("open"),
        F.max("cents").alias("high"),
        F.min("cents").alias("low"),
        F.max_by("cents", "o_orderkey").alias("close"),
        F.coalesce(F.sum("q"), F.lit(0)).cast("long").alias("volume"),
    )


def context_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, vx, sk (cents): two context indices; some days are missing."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    days = lines.where(F.dayofmonth("date") % 7 != 0)
    return days.groupBy("date").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("cents"))).alias("vx"), F.min(F.when(F.col("l_returnflag") == "N", F.col("cents"))).alias("sk"))


def bars_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (minute, UTC), open, high, low, close (cents), volume: the events of a type and minute."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("minute"), F.struct("ts", "event_id").alias("at"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return events.groupBy("symbol", F.col("minute").alias("ts")).agg(
        F.min_by("cents", "at").alias("open"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.max_by("cents", "at").alias("close"), F.count("*").alias("volume")
    )


def calendar(minutes: DataFrame) -> DataFrame:
    """date, close_et: the weekdays of the minutes (column date); a day in thirteen closes at 13:00, the others at 16:00. A row a day, a few hundred a year."""
    days = minutes.select("date").distinct().where(F.dayofweek("date").between(2, 6))
    hour = F.when(F.dayofmonth("date") % 13 == 0, 13).otherwise(16)
    return days.withColumn("close_et", (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)).cast("timestamp_ntz"))


def bars_of_days(minutes: DataFrame) -> DataFrame:
    """symbol, date, open, high, low, close (cents), volume: minute bars (with date, ts) by day."""
    return minutes.groupBy("symbol", "date").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").cast("long").alias("volume")
    )
