"""Distances between two weighted distributions, as aggregates over rows of both.

Rows: keys, v (value), wa and wb (weights on either side).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored


def weight_distances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mae, mse): mean absolute and squared difference of weights over the common support."""
    gap = F.col("wa") - F.col("wb")
    return rows.groupBy(*keys, "v").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb")).groupBy(*keys).agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))


def mean_distances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, abs_av_diff, mape): difference of weighted means, and as a share of b's (of a's if b's is 0), at most 1."""
    mean = lambda w: F.sum(F.col("v") * F.col(w)) / F.sum(w)
    means = rows.groupBy(*keys).agg(mean("wa").alias("a"), mean("wb").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    base = F.when(F.col("b") == 0, F.col("a")).otherwise(F.col("b"))
    share = F.when(gap == 0, 0.0).otherwise(F.least(F.lit(1.0), gap / F.nullif(base, F.lit(0.0))))
    return means.select(*keys, gap.alias("abs_av_diff"), share.alias("mape"))


def wasserstein(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distance): first Wasserstein distance on a line."""
    points = rows.groupBy(*keys, "v").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    upto, whole = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
    share = lambda c: F.sum(c).over(upto) / F.sum(c).over(whole)
    step = F.abs(share("wa") - share("wb")) * (F.lead("v").over(upto) - F.col("v"))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).groupBy(*keys).agg(F.sum("step").alias("distance"))


def random_directions(size: int, projections: int = 100, seed: int = 0) -> np.ndarray:
    """Unit vectors, a row each; the same for the same arguments."""
    directions = np.random.default_rng(seed).normal(size=(projections, size))
    return directions / np.linalg.norm(directions, axis=1, keepdims=True)


def sliced_distances(points: DataFrame, base: str, others: list[str], projections: int = 100, seed: int = 0) -> dict[str, float | None]:
    """Mean Wasserstein distance over random directions of base from each of the others; points: (side, x array<double>).

    Equal points are one. All sides share one sort by direction: points of a third side only cut a step in two.
    """
    sides = [base, *others]
    count = [F.count_if(F.col("side") == s).alias(f"w{i}") for i, s in enumerate(sides)]
    distinct = stored(points.where(F.col("side").isin(sides)).groupBy("x").agg(*count), "points")
    size, *totals = distinct.agg(F.max(F.size("x")), *[F.sum(f"w{i}") for i in range(len(sides))]).first()
    if size is None:
        return dict.fromkeys(others)
    directions = random_directions(size, projections, seed)
    dot = lambda d: reduce(lambda s, c: s + c, [F.col("x")[k] * F.lit(float(c)) for k, c in enumerate(d)])
    weights = [f"w{i}" for i in range(len(sides))]
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    spread = distinct.repartition(tasks).select(F.posexplode(F.array(*[dot(d) for d in directions])).alias("direction", "v"), *weights)
    order = Window.partitionBy("direction").orderBy("v")
    share = lambda i: F.sum(f"w{i}").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(totals[i] or None)
    # Of rows with the same v only the last has a step.
    steps = {f"s{i}": F.abs(share(0) - share(i)) * (F.lead("v").over(order) - F.col("v")) for i in range(1, len(sides))}
    found = spread.repartition(2 * projections, "direction").withColumns(steps).agg(*[F.sum(F.coalesce(s, F.lit(0.0))).alias(s) for s in steps]).first()
    return {s: found[f"s{i}"] / projections if totals[0] and totals[i] else None for i, s in enumerate(sides) if i}


def sliced_wasserstein(points: DataFrame, projections: int = 100, seed: int = 0) -> float:
    """Mean Wasserstein distance of two point sets over random directions; points: (side 'a' or 'b', x array<double>)."""
    return sliced_distances(points, "a", ["b"], projections, seed)["b"]


def mape_scalar(a: np.ndarray, b: np.ndarray) -> float:
    """Mean of |a - b| / |a|."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(np.abs((a - b) / a).mean())


def same_histograms(a: DataFrame, b: DataFrame) -> bool:
    """Whether two histograms hold the same rows."""
    columns = sorted(a.columns)
    return columns == sorted(b.columns) and a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()
