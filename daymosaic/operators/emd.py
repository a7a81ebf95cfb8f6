"""Distances between the observed and each model's histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transport import emd_points
from ..plans.jobs import Jobs
from ..schema import OBSERVED
from .features import CELL, hooked


def line_distances(sides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): earth mover's distance on a line from rows (keys, v1, wa, wb), in one window over the values.

    A side without any weight is a point at 0.
    """
    points = sides.groupBy(*keys, "v1").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    totals = points.groupBy(*keys).agg(F.sum("wa").alias("na"), F.sum("wb").alias("nb"))
    lone = totals.where("na = 0 or nb = 0").select(*keys, F.lit(0.0).alias("v1"), F.when(F.col("na") == 0, 1).otherwise(0).cast("long").alias("wa"), F.when(F.col("nb") == 0, 1).otherwise(0).cast("long").alias("wb"))
    points = points.unionByName(lone).groupBy(*keys, "v1").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    upto = Window.partitionBy(*keys).orderBy("v1")
    whole = Window.partitionBy(*keys)
    share = lambda c: F.sum(c).over(upto) / F.sum(c).over(whole)
    step = F.abs(share("wa") - share("wb")) * (F.lead("v1").over(upto) - F.col("v1"))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).groupBy(*keys).agg(F.sum("step").alias("value"))


def plane_distances(sides: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """(keys, value): exact earth mover's distance in the plane from rows (keys, v1, v2, wa, wb).

    One group is one segment's cells, which the bins bound however many episodes there are. scale: a divisor of all
    coordinates, so that costs are whole numbers when bins are.
    """
    schema = sides.select(*keys).schema.add("value", "double")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        points = np.rint(group[["v1", "v2"]].to_numpy() / scale * 2) / 2
        wa, wb = group["wa"].to_numpy(), group["wb"].to_numpy()
        a, b = wa > 0, wb > 0
        value = emd_points(points[a], wa[a], points[b], wb[b]) * scale if a.any() and b.any() else float("nan")
        return group[keys].head(1).assign(value=value)

    cells = sides.groupBy(*keys, "v1", "v2").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    # Few rows but much work: a fixed number of partitions, which Spark doesn't merge for being small.
    tasks = 4 * sides.sparkSession.sparkContext.defaultParallelism
    return cells.repartition(tasks, *keys).groupBy(*keys).applyInPandas(solve, schema)


def paired(hist: DataFrame, models: list[str]) -> DataFrame:
    """(cell, v1, v2, wa, wb): the observed histogram for each model, and the model's own."""
    other = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    observed = hist.where(F.col("model") == OBSERVED).drop("model").select(other, "label", "cat", "fid", "segment", "v1", "v2", F.col("w").alias("wa"), F.lit(0).cast("long").alias("wb"))
    own = hist.where(F.col("model") != OBSERVED).select(*CELL, "v1", "v2", F.lit(0).cast("long").alias("wa"), F.col("w").alias("wb"))
    return observed.unionByName(own)


def scored(hist: DataFrame, keys: DataFrame, models: list[str], jobs: Jobs) -> DataFrame:
    """(cell, value) of all keys; keys: cells with has_a and has_b, whether each side has weight."""
    features = jobs.all_features
    sides = paired(hist, models)
    penal = [i for i, f in enumerate(features) if f.missing is not None]
    planes = [i for i, f in enumerate(features) if f.dims == 2]
    penalty = F.coalesce(*[F.when(F.col("fid") == i, F.lit(features[i].missing)) for i in penal], F.lit(None).cast("double"))
    lines = line_distances(sides.where(~F.col("fid").isin(planes)) if planes else sides, CELL)
    if planes:
        lines = lines.unionByName(plane_distances(sides.where(F.col("fid").isin(planes)), CELL, jobs.bin / jobs.day))
    lines = hooked(lines, "value", sides, features, "distance")
    both = F.col("has_a") & F.col("has_b")
    value = F.when(~both & F.col("fid").isin(penal), penalty).otherwise(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))
    return keys.join(lines, CELL, "left").withColumn("value", value)
