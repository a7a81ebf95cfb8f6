"""Values of all features are made in tasks of a bounded size."""

from pyspark.sql import functions as F

from daymosaic.operators import features
from daymosaic.plans.jobs import FEATURES, Jobs

JOBS = Jobs(tuple(f for f in FEATURES if f.default))


def test_tasks_do_not_grow_with_the_persons(spark, monkeypatch):
    acts = F.element_at(F.array(*map(F.lit, ("home", "work", "shop"))), (F.col("id") % 7 % 3 + 1).cast("int"))
    sched = spark.range(4000).select(F.when(F.col("id") < 2000, "m").otherwise("observed").alias("model"), (F.col("id") / 4).cast("long").alias("pid"), acts.alias("act"), (F.col("id") % 4 * 360.0).alias("start"), (F.col("id") % 4 * 360.0 + 360).alias("end"), F.lit(360.0).alias("duration"), (F.col("id") % 4 + 1).cast("int").alias("seq"))
    counted = lambda: features.value_counts(features.feature_rows(sched, JOBS)).select("fid", "segment", "v1", "v2", "w")
    want = sorted(map(repr, counted().collect()))
    monkeypatch.setattr(features, "EPISODES", 100)
    assert sorted(map(repr, counted().collect())) == want
    placed = features.feature_rows(sched, JOBS).select("pid", F.spark_partition_id().alias("task")).toPandas()
    assert placed.groupby("task")["pid"].nunique().max() < 80  # of 1,000 persons; 4 shuffle partitions had some 250 each
