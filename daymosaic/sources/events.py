"""Schedules from an event log: one schedule per user and day, tiling the day from 0 to 1440 minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTS = {"view": "home", "click": "shop", "purchase": "work", "signup": "education"}


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, pid, user_id, d, act, start, end, duration, seq) of the `events` table; days up to 15 are observed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    act = F.lit("leisure")
    for kind, name in ACTS.items():
        act = F.when(F.col("event_type") == kind, name).otherwise(act)
    e = e.select("user_id", "event_id", F.dayofmonth("ts").alias("d"), (F.hour("ts") * 60 + F.minute("ts")).alias("m"), act.alias("act"))
    w = Window.partitionBy("user_id", "d").orderBy("m", "event_id")
    e = e.withColumns({"seq": F.row_number().over(w), "next": F.coalesce(F.lead("m").over(w), F.lit(1440))})
    start = F.when(F.col("seq") == 1, 0).otherwise(F.col("m"))
    model = F.when(F.col("d") <= 15, "observed").when(F.col("d") % 2 == 0, "model_a").otherwise("model_b")
    return e.select(model.alias("model"), (F.col("user_id") * 100 + F.col("d")).alias("pid"), "user_id", "d", "act", start.cast("double").alias("start"), F.col("next").cast("double").alias("end"), (F.col("next") - start).cast("double").alias("duration"), "seq")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, segment, acctbal) of each schedule's user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("pid"), "user_id").distinct()
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"))
    return e.join(c, "user_id").select("pid", "segment", "acctbal")
