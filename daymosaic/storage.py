"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own_roots: dict[str, str] = {}
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = _own_roots.setdefault(spark.sparkContext.applicationId, "")
        if not root:
            root = _own_roots[spark.sparkContext.applicationId] = Path(tempfile.mkdtemp(prefix="shared-")).as_uri()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many paths this process has made so far."""
    return len(_made)


def discard(spark: SparkSession, since: int, last: int) -> None:
    """Delete the paths from number `since` to `last` (exclusive), which nothing reads any more."""
    while last > since:
        last -= 1
        _delete(spark, _made.pop(last))


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], rows: int, cell: int = 100_000) -> DataFrame:
    """df with, for each name, the sum of the column over all rows before (exclusive), in the given total order.

    Rows are dealt by range, so a task sorts about `cell` of them; only the parts' totals, a row each, meet in one window.
    """
    parts = max(1, -(-rows // cell))
    placed = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "running")
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(above), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    local = local.join(F.broadcast(bases) if parts <= 1_000_000 else bases, "_part")
    return local.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_part", *[f"_b_{n}" for n in sums])


def cleanup(spark: SparkSession) -> None:
    """Delete all that this process has stored in the shared folder. Results that weren't written elsewhere are lost."""
    discard(spark, 0, len(_made))
