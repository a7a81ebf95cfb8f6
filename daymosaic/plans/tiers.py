"""Roll-ups of raw rows: features, groups and domains, each with a weighting of its own.

Raw rows are long: (domain, feature, segment, label, cat, model, value, weight, unit), distances with obs_weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import DROP_FEATURES, DROP_GROUPS


def dropped(rows: DataFrame, keys: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Rows without those that begin with one of the keys."""
    keep: Column = F.lit(True)
    for key in keys:
        here: Column = F.lit(True)
        for column, value in zip(("domain", "feature", "segment"), key, strict=False):
            here = here & (F.col(column) == value)
        keep = keep & ~here
    return rows.where(keep)


def described(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean by each model's own weights; 0 without weight."""
    value = F.coalesce(F.sum(F.col("value") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0)), F.lit(0.0))
    return rows.groupBy(*by, "model").agg(value.alias("value"), F.sum("weight").cast("double").alias("weight"), F.max("unit").alias("unit"))


def scored(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean by the average of a model's and the observed weight; segments that weren't observed don't count."""
    weight = (F.col("weight") + F.col("obs_weight")) / 2
    value = F.sum(F.col("value") * weight) / F.nullif(F.sum(weight), F.lit(0.0))
    return rows.groupBy(*by, "model").agg(value.alias("value"), F.sum(weight).alias("weight"), F.max("unit").alias("unit"))


def averaged(groups: DataFrame, by: list[str]) -> DataFrame:
    """Plain mean over groups."""
    return groups.groupBy(*by, "model").agg(F.avg("value").alias("value"))


def tier(rows: DataFrame, level: str, extra: list[str], distances: bool, drop_features: tuple = DROP_FEATURES, drop_groups: tuple = DROP_GROUPS) -> DataFrame:
    """Long rows of a level: features, groups or domains. extra: [], ["label"] or ["label", "cat"]."""
    roll = scored if distances else described
    if level == "features":
        return roll(rows, ["domain", "feature", "segment", *extra])
    groups = roll(dropped(rows, drop_features), ["domain", "feature", *extra])
    if level == "groups":
        return groups
    return averaged(dropped(groups, drop_groups), ["domain", *extra])


#: Weight of a row of a wide table, by which rows of a feature are put in order.
WEIGHT = "_weight"


def wide(rows: DataFrame, by: list[str], models: list[str], fill: float | None = None, weighed: bool = False) -> DataFrame:
    """A column per model, and the unit where there is one. weighed: also the first model's weight, or without it the greatest."""
    unit = [F.max("unit").alias("unit")] if "unit" in rows.columns else []
    first = F.coalesce(F.max(F.when(F.col("model") == models[0], F.col("weight"))), F.max("weight"))
    out = rows.groupBy(*by).agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in models], *unit, *([first.alias(WEIGHT)] if weighed else []))
    return out.fillna(fill, subset=models) if fill is not None else out
