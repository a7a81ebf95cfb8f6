"""Console and CSV reports of results, and ranks of models."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import save_csv
from .evaluate import EvalResult
from .tiers import WEIGHT


def as_text(df: DataFrame) -> str:
    """A small table as Markdown."""
    pdf = df.toPandas()
    show = lambda x: f"{x:.3f}" if isinstance(x, float) else str(x)
    rows = [[str(c) for c in pdf.columns], *[[show(x) for x in r] for r in pdf.itertuples(index=False)]]
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    lines = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "|".join("-" * (w + 2) for w in width) + "|", *lines[1:]])


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, model, rank): place of each model in each row of (by, model, value); equal values share the better place."""
    return rows.select(*by, "model", F.rank().over(Window.partitionBy(*by).orderBy("value")).alias("rank"))


def models_by_rank(ranks: DataFrame) -> list[str]:
    """Models by the sum of their ranks, ties by name."""
    return [r["model"] for r in ranks.groupBy("model").agg(F.sum("rank").alias("total")).orderBy("total", "model").collect()]


def head(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows of each group: the heaviest, if rows have weights, and then by all columns."""
    others = [c for c in df.columns if c not in by and c != WEIGHT]
    order = [F.col(WEIGHT).desc()] * (WEIGHT in df.columns) + [F.col(c) for c in others]
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= n).drop("_place", WEIGHT)


def add_stats(df: DataFrame, models: list[str]) -> DataFrame:
    """Adds mean and (sample) std over the models' columns."""
    n = len(models)
    mean = sum((F.col(m) for m in models[1:]), F.col(models[0])) / n
    spread = sum(((F.col(m) - mean) ** 2 for m in models[1:]), (F.col(models[0]) - mean) ** 2)
    return df.withColumns({"mean": mean, "std": F.sqrt(spread / (n - 1)) if n > 1 else F.lit(None).cast("double")})


def report(result: EvalResult, log_dir: str | Path | None = None, first: int | None = None, splits: bool = False, ranking: bool = False) -> str:
    """All levels as text; with log_dir also as CSV files. first: rows of each feature to show."""
    out, view = [], "by_attribute" if splits else "combined"
    extra = ["label"] if splits else []
    for level, by in (("features", ["domain", "feature"]), ("groups", ["domain", "feature"]), ("domains", ["domain"])):
        got = getattr(getattr(result, level), view)
        for name, df, weighed in zip(("descriptions", "distances"), (got.descriptions, got.distances), got.weighed, strict=True):
            if log_dir is not None:
                save_csv(df, f"{log_dir}/{level}_{name}.csv")
            shown = head(weighed, by + extra, first) if first is not None and level == "features" else df
            out += [f"\n{level} {name}:", as_text(shown)]
        if ranking and level != "features":
            keys = by + extra
            long = got.distances.unpivot(keys, result.model_names, "model", "value")
            ranks = ranked(long, keys)
            order = models_by_rank(ranks)
            out += [f"\n{level} distances, ranked:", as_text(ranks.groupBy(*keys).pivot("model", order).agg(F.max("rank")))]
    return "\n".join(out)


def _mean_by(report: DataFrame, suffix: str, weight: Callable[[str], Column]) -> dict[str, float | None]:
    columns = [c for c in report.columns if not c.endswith(suffix) and f"{c}{suffix}" in report.columns]
    total = lambda c: F.sum(weight(c))
    row = report.agg(*[F.try_divide(F.sum(F.col(f"`{c}`") * weight(c)), total(c)).alias(c) for c in columns]).first()
    return row.asDict() if columns else {}


def weighted_average(report: DataFrame, suffix: str = "__weight") -> dict[str, float | None]:
    """Mean of each column of a wide table by the weights in the column of its name and suffix (null without weight)."""
    return _mean_by(report, suffix, lambda c: F.col(f"`{c}{suffix}`"))


def distance_weighted_average(report: DataFrame, base_col: str = "observed__weight", suffix: str = "__weight") -> dict[str, float | None]:
    """The same by the mean of a column's own weights and those in base_col."""
    return _mean_by(report, suffix, lambda c: (F.col(f"`{c}{suffix}`") + F.col(f"`{base_col}`")) / 2)


def heatmap_table(result: EvalResult) -> pd.DataFrame:
    """Group distances of all models, for a heat map."""
    return result.groups.combined.distances.toPandas().set_index(["domain", "feature"])
