"""Histograms that grow with a stream of schedules.

Counts add up, so micro-batches of whole schedules give the histograms of everything that has arrived. Rare n-grams
are left out only when totals are read, as no single batch can tell.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import features
from ..plans.jobs import Jobs
from ..schema import canonical


def batch_counts(batch: DataFrame, jobs: Jobs, model: str) -> tuple[DataFrame, DataFrame]:
    """(rows of values above 0 by segment, persons by least length) of a batch of whole schedules."""
    sched = canonical(batch, validate=False).withColumn("model", F.lit(model))
    rows = features.feature_rows(sched, replace(jobs, min_count=0))
    counts = rows.groupBy("fid", "segment", "v1", "v2").agg(F.any_value("acts").alias("acts"), F.count("*").alias("w"))
    lengths = sched.groupBy("pid").agg(F.count("*").alias("len")).groupBy("len").agg(F.count("*").alias("persons"))
    return counts, lengths


def accumulate(stream: DataFrame, path: str, checkpoint: str, jobs: Jobs | None = None, model: str = "stream", once: bool = False) -> StreamingQuery:
    """Append each micro-batch's counts below path. A batch that is run again after a failure replaces its own counts."""
    jobs = jobs or Jobs()

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        counts, lengths = batch_counts(batch, jobs, model)
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        lengths.write.mode("overwrite").parquet(f"{path}/lengths/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(spark: SparkSession, path: str, jobs: Jobs | None = None) -> DataFrame:
    """(fid, segment, v1, v2, w) of all batches, with zero buckets and without rare n-grams."""
    jobs = jobs or Jobs()
    counts = spark.read.parquet(f"{path}/counts").groupBy("fid", "segment", "v1", "v2").agg(F.sum("w").alias("w"))
    lengths = spark.read.parquet(f"{path}/lengths")
    sizes = lengths.agg(F.sum("persons").alias("n_all"), *[F.coalesce(F.sum(F.when(F.col("len") >= n, F.col("persons"))), F.lit(0)).alias(f"n_{n}") for n in (2, 3, 4)])
    jobs_features = jobs.all_features
    grams = [i for i, f in enumerate(jobs_features) if f.section == "transitions"]
    own = counts.groupBy("fid", "segment").agg(F.sum("w").alias("some"), F.sum(F.col("v1") * F.col("w")).alias("total")).withColumn("one", F.lit(1)).join(F.broadcast(sizes.withColumn("one", F.lit(1))), "one")
    kept = own.where(~(F.col("fid").isin(grams) & (F.col("total") < jobs.min_count) & (F.col("n_all") > jobs.min_count_trigger)))
    base = F.coalesce(*[F.when(F.col("fid") == i, F.col(f"n_{f.zeros}")) for i, f in enumerate(jobs_features) if f.zeros is not None], F.lit(None).cast("long"))
    zero = kept.select("fid", "segment", F.lit(0.0).alias("v1"), F.lit(None).cast("double").alias("v2"), (base - F.col("some")).alias("w")).where("w > 0")
    return counts.join(kept.select("fid", "segment"), ["fid", "segment"], "left_semi").unionByName(zero)
