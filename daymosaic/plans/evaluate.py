"""Comparing synthetic populations with an observed one.

All populations are one long table, and every feature of it one plan; only the exact two-dimensional distances leave
the JVM. The tables between steps (value counts, segments, histograms, raw rows) are stored in the shared folder: they
are smaller than the input, and a lost executor costs no recomputation of the steps before.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import cached_property, reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import emd, features, splits, structure
from ..schema import OBSERVED, as_table, canonical, population
from ..sources.files import save_csv
from ..storage import stored
from . import tiers
from .jobs import DROP_FEATURES, DROP_GROUPS, Feature, Jobs, get_jobs

KEY = ["domain", "feature", "segment", "label", "cat"]


class SplitNotAvailableError(AttributeError):
    """A split view of a result that has no splits."""


def _named(rows: DataFrame, jobs: Jobs) -> DataFrame:
    name = lambda a: features.feature_name(jobs.all_features, a)
    return rows.withColumns({"domain": name("domain"), "feature": name("name")})


def density_rows(sched: DataFrame, members: DataFrame, models: list[str], jobs: Jobs) -> tuple[DataFrame, DataFrame]:
    """Raw descriptions and distances of all features that are distributions."""
    jobs_features = jobs.all_features
    splits_on = members.where(F.col("label") != features.NO_SPLIT).limit(1).count() > 0
    counts = stored(features.value_counts(features.feature_rows(sched, jobs), members if splits_on else None), "counts")
    wanted = stored(features.segments(sched, counts, jobs), "segments")
    hist = features.histograms(counts, wanted, members, jobs)
    cats = members.where(F.col("model") == OBSERVED).select("label", "cat").distinct()
    hist = hist.join(cats, ["label", "cat"], "left_semi")
    # A model's segment counts only where its category has all of the segment's activities.
    present = sched.where("act is not null").join(members, ["model", "pid"]).groupBy("model", "label", "cat").agg(F.collect_set("act").alias("present"))
    allowed = wanted.where(F.col("model") != OBSERVED).join(present, "model").where(F.size(F.array_except("acts", "present")) == 0).select(*features.CELL)
    hist = hist.where(F.col("model") == OBSERVED).unionByName(hist.where(F.col("model") != OBSERVED).join(allowed, features.CELL, "left_semi"))
    hist = stored(hist, "histograms")
    described = features.hooked(features.described(hist), "weight", hist, jobs_features, "size")
    described = features.hooked(described, "value", hist, jobs_features, "describe_by")
    # Observed segments are those of the whole observed population, also where a category has none.
    own = wanted.where(F.col("model") == OBSERVED).select("model", "fid", "segment").join(cats.withColumn("model", F.lit(OBSERVED)), "model")
    mean = [i for i, f in enumerate(jobs_features) if f.describe == "mean"]
    empty = F.when(F.col("fid").isin(mean), F.lit(0.0))
    observed = own.join(described, features.CELL, "left").select(*features.CELL, F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("value", empty).alias("value"))
    model_rows = described.where(F.col("model") != OBSERVED)
    unit = features.feature_name(jobs_features, "unit")
    descriptions = _named(observed.unionByName(model_rows.select(*observed.columns)).withColumn("unit", unit), jobs).select(*KEY, "model", "value", "weight", "unit")

    other = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    sides = observed.select(other, "label", "cat", "fid", "segment", F.col("weight").alias("obs_weight"))
    cell = features.CELL
    keys = sides.join(model_rows.select(*cell, "weight"), cell, "full").withColumns({"has_a": F.coalesce(F.col("obs_weight") > 0, F.lit(False)), "has_b": F.coalesce(F.col("weight") > 0, F.lit(False))})
    scored = emd.scored(hist, keys, models, jobs)
    distances = _named(scored, jobs).select(*KEY, "model", "value", F.coalesce("weight", F.lit(0)).alias("weight"), "obs_weight", F.when(F.col("obs_weight").isNotNull(), F.lit("EMD")).alias("unit"))
    return descriptions, distances


def creativity_rows(sched: DataFrame, sizes: DataFrame, placed: DataFrame, jobs: Jobs) -> tuple[DataFrame, DataFrame]:
    """Diversity and novelty of whole schedules, and their opposites.

    sizes: (model, label, cat, n) persons of the attributes tables; placed: signatures with label and cat.
    """
    cell = ["model", "label", "cat"]
    distinct = placed.select(*cell, "signature").distinct()
    known = distinct.where(F.col("model") == OBSERVED).select("label", "cat", "signature")
    own = distinct.groupBy(*cell).agg(F.count("*").alias("different"))
    fresh = distinct.where(F.col("model") != OBSERVED).join(known, ["label", "cat", "signature"], "left_anti").groupBy(*cell).agg(F.count("*").alias("new"))
    joined = sizes.join(own, cell, "left").join(fresh, cell, "left").fillna(0, ["different", "new"])
    diversity = F.when(F.col("n") > 0, F.col("different") / F.nullif("n", F.lit(0))).otherwise(0.0)
    novelty = F.when(F.col("model") == OBSERVED, 1.0).when(F.col("different") > 0, F.col("new") / F.nullif("different", F.lit(0))).otherwise(0.0)

    def rows(entries: list[tuple]) -> DataFrame:
        made = F.array(*[F.struct(F.lit(name).alias("feature"), value.alias("value"), F.lit(unit).alias("unit")) for name, value, unit in entries])
        return joined.select(*cell, F.col("n").alias("weight"), F.explode(made).alias("e")).select(F.lit("creativity").alias("domain"), "e.feature", F.lit("all").alias("segment"), "label", "cat", "model", "e.value", "weight", "e.unit")

    desc = [("diversity", diversity, "prob. unique")] * jobs.diversity + [("novelty", novelty, "prob. novel")] * jobs.novelty
    dist = [("homogeneity", 1 - diversity, "prob. not unique")] * jobs.diversity + [("conservatism", 1 - novelty, "prob. conservative")] * jobs.novelty
    return rows(desc), rows(dist)


def feasibility_rows(sched: DataFrame, members: DataFrame, placed: DataFrame | None, jobs: Jobs, cells: DataFrame) -> DataFrame:
    """Shares of infeasible schedules; cells (model, label, cat) without persons have 0."""
    by = ["model", "label", "cat"]
    people = structure.flags(sched).join(members.select(*by, "pid"), ["model", "pid"])
    plan = [(structure.rate_rows(jobs.home_based, jobs.consecutive), people)]
    if jobs.needs_novel and placed is not None:
        known = placed.where(F.col("model") == OBSERVED).select("label", "cat", "signature").distinct()
        fresh = placed.where(F.col("model") != OBSERVED).join(known, ["label", "cat", "signature"], "left_anti").select(*by, "pid")
        plan.append((structure.rate_rows(jobs.home_based_novel, jobs.consecutive_novel, " (novel)"), people.join(fresh, [*by, "pid"], "left_semi")))
    parts = []
    for i, (rows, who) in enumerate(plan):
        if not rows:
            continue
        named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(s).alias("segment")) for f, s, _ in rows])).alias("e")
        frame = cells.select(*by, "n", named).select(*by, "n", "e.feature", "e.segment")
        rates = structure.rates(who, rows, by)
        # By definition no observed schedule is novel; its weight is its persons.
        weight = F.when((F.col("model") == OBSERVED) & F.lit(i == 1), F.col("n")).otherwise(F.coalesce("weight", F.lit(0)))
        parts.append(frame.join(rates, [*by, "feature", "segment"], "left").select(F.lit("feasibility").alias("domain"), "feature", "segment", "label", "cat", "model", F.coalesce("value", F.lit(0.0)).alias("value"), weight.alias("weight"), F.lit("prob. infeasible").alias("unit")))
    return reduce(DataFrame.unionByName, parts)


def _with_observed_weight(rows: DataFrame) -> DataFrame:
    """Distance rows of models with the observed weight of the same row."""
    observed = rows.where(F.col("model") == OBSERVED).select(*KEY, F.col("weight").alias("obs_weight"))
    return rows.where(F.col("model") != OBSERVED).join(observed, KEY, "left").select(*KEY, "model", "value", "weight", "obs_weight", "unit")


class AggregatedResult:
    """Descriptions and distances of one level; wide Spark tables, a column per model."""

    def __init__(self, descriptions: DataFrame, distances: DataFrame, label: str = "", by: list[str] | None = None) -> None:
        # With their weights, if the level has any; of a feature's rows the heaviest stand first.
        self.weighed, self.label = (descriptions, distances), label
        self.descriptions, self.distances = (self._ordered(df, by or []) for df in self.weighed)

    @staticmethod
    def _ordered(df: DataFrame, by: list[str]) -> DataFrame:
        if tiers.WEIGHT not in df.columns:
            return df.orderBy(*by) if by else df
        first = [F.col(OBSERVED).desc()] if OBSERVED in df.columns else []
        return df.orderBy(*[c for c in by if c != "segment"], F.col(tiers.WEIGHT).desc(), *first, "segment").drop(tiers.WEIGHT)

    def __repr__(self) -> str:
        return f"AggregatedResult [{self.label}]\n\n{self.distances.toPandas().to_string()}"

    def save(self, path: str | Path) -> None:
        """Write descriptions.csv and distances.csv."""
        save_csv(self.descriptions, f"{path}/descriptions.csv")
        save_csv(self.distances, f"{path}/distances.csv")


class ScheduleView:
    """One level of a result: combined, by_attribute or by_category."""

    def __init__(self, result: EvalResult, level: str) -> None:
        self._result, self._level = result, level

    def _roll(self, extra: list[str], label: str) -> AggregatedResult:
        by = {"features": ["domain", "feature", "segment"], "groups": ["domain", "feature"], "domains": ["domain"]}[self._level] + extra
        r = self._result
        desc = tiers.tier(r.raw_descriptions, self._level, extra, False, r.drop_features, r.drop_groups)
        dist = tiers.tier(r.raw_distances, self._level, extra, True, r.drop_features, r.drop_groups)
        fill = 0.0 if self._level != "domains" else None
        weighed = self._level == "features"
        return AggregatedResult(tiers.wide(desc, by, [OBSERVED, *r.model_names], fill, weighed), tiers.wide(dist, by, r.model_names, None, weighed), f"{self._level} x {label}", by)

    def _split(self, extra: list[str], label: str) -> AggregatedResult:
        if not self._result.has_splits:
            raise SplitNotAvailableError(f"{label} is not available: the result was made without split_on")
        return self._roll(extra, label)

    @cached_property
    def combined(self) -> AggregatedResult:
        return self._roll([], "combined")

    @cached_property
    def by_attribute(self) -> AggregatedResult:
        return self._split(["label"], "by_attribute")

    @cached_property
    def by_category(self) -> AggregatedResult:
        return self._split(["label", "cat"], "by_category")

    def __repr__(self) -> str:
        views = ".combined" + " / .by_attribute / .by_category" * self._result.has_splits
        return f"ScheduleView [{self._level}]  ({views})\n\n{self.combined.distances.toPandas().to_string()}"


class EvalResult:
    """Raw rows of a comparison; levels are computed on demand."""

    def __init__(self, descriptions: DataFrame, distances: DataFrame, models: list[str], has_splits: bool, drop_features: tuple = DROP_FEATURES, drop_groups: tuple = DROP_GROUPS) -> None:
        self.raw_descriptions, self.raw_distances = descriptions, distances
        self.model_names, self.has_splits = list(models), has_splits
        self.drop_features, self.drop_groups = drop_features, drop_groups

    @property
    def raw(self) -> dict[str, DataFrame]:
        """Long rows before any roll-up."""
        return {"descriptions": self.raw_descriptions, "distances": self.raw_distances}

    @cached_property
    def features(self) -> ScheduleView:
        return ScheduleView(self, "features")

    @cached_property
    def groups(self) -> ScheduleView:
        return ScheduleView(self, "groups")

    @cached_property
    def domains(self) -> ScheduleView:
        return ScheduleView(self, "domains")

    def summary(self) -> DataFrame:
        """Domain distances of each model."""
        return self.domains.combined.distances

    def rank_models(self) -> DataFrame:
        """(model, distance): mean domain distance, ascending."""
        rows = tiers.tier(self.raw_distances, "domains", [], True, self.drop_features, self.drop_groups)
        return rows.groupBy("model").agg(F.avg("value").alias("distance")).orderBy("distance", "model")

    @property
    def best_model(self) -> str:
        return self.rank_models().first()["model"]

    def __repr__(self) -> str:
        return f"EvalResult: {len(self.model_names)} model(s): {', '.join(self.model_names)}\n\n{self.summary().toPandas().to_string()}"

    def save(self, path: str | Path) -> None:
        """CSV files of all levels, in a folder per level and split."""
        for level in ("features", "groups", "domains"):
            view = getattr(self, level)
            view.combined.save(f"{path}/{level}")
            if self.has_splits:
                view.by_attribute.save(f"{path}/{level}_by_attribute")
                view.by_category.save(f"{path}/{level}_by_category")


class Evaluator:
    """Holds an observed population and compares models with it, at once or one by one."""

    def __init__(self, target: object, target_attributes: object | None = None, split_on: list[str] | None = None, config_path: str | Path | None = None, jobs: Jobs | None = None, order_col: str | None = None, extra: tuple[Feature, ...] = ()) -> None:
        if (target_attributes is None) != (split_on is None):
            raise ValueError("target_attributes and split_on must be given together or not at all")
        self.jobs = jobs or get_jobs(config_path)
        if extra:
            self.jobs = Jobs(**{**self.jobs.__dict__, "extra": extra})
        self.order_col, self.split_on, self.edges = order_col, list(split_on or []), {}
        self.target = canonical(target, order_col)
        self.attributes: DataFrame | None = None
        if target_attributes is not None:
            table = as_table(target_attributes, self.target.sparkSession)
            self._check_attributes(table, "target_attributes")
            self.edges = splits.numeric_edges(table, self.split_on)
            self.attributes = splits.unpivoted(table, self.split_on, self.edges)
        self.reset()

    def _check_attributes(self, table: DataFrame, what: str) -> None:
        if "pid" not in table.columns:
            raise ValueError(f"{what} is missing required column 'pid'")
        if missing := [c for c in self.split_on if c not in table.columns]:
            raise ValueError(f"split column(s) {missing} not found in {what}")

    def reset(self) -> None:
        """Forget the models."""
        self._models: dict[str, DataFrame] = {}
        self._attributes: dict[str, DataFrame] = {}

    def __repr__(self) -> str:
        acts = sorted(r[0] for r in self.target.select("act").distinct().collect() if r[0] is not None)
        lines = ["Evaluator(", f"  persons   : {self.target.select('pid').distinct().count():,}", f"  activities: {', '.join(acts)}"]
        if self.attributes is not None:
            for r in self.attributes.groupBy("label").agg(F.array_sort(F.collect_set("cat")).alias("c")).orderBy("label").collect():
                lines.append(f"  split     : {r['label']} -> {r['c']}")
        return "\n".join([*lines, ")"])

    def compare_population(self, model: str, schedule: object, attributes: object | None = None) -> None:
        """Add a model; report() has the results of all that were added."""
        if model == OBSERVED:
            raise ValueError(f"a model can't be called '{OBSERVED}'")
        spark = self.target.sparkSession
        if self.split_on:
            if attributes is None:
                raise ValueError("attributes are required, as the evaluator was made with split_on")
            table = as_table(attributes, spark)
            self._check_attributes(table, f"attributes of model '{model}'")
            self._attributes[model] = splits.unpivoted(table, self.split_on, self.edges)
        elif attributes is not None:
            raise ValueError("attributes need an evaluator with target_attributes and split_on")
        self._models[model] = canonical(schedule, self.order_col, spark=spark)

    def compare(self, synthetic: Mapping[str, object], attributes: Mapping[str, object] | None = None) -> EvalResult:
        """Compare models by name; attributes: a table for each, as the splits need."""
        self.reset()
        for model, schedule in synthetic.items():
            self.compare_population(model, schedule, attributes[model] if attributes is not None else None)
        return self.report()

    def compare_populations(self, synthetic_schedules: Mapping[str, object], synthetic_attributes: Mapping[str, object] | None = None) -> EvalResult:
        return self.compare(synthetic_schedules, synthetic_attributes)

    def report(self) -> EvalResult:
        """Results of the models that were added."""
        if not self._models:
            raise ValueError("no model was added")
        jobs, models = self.jobs, list(self._models)
        sched = stored(population({OBSERVED: self.target, **self._models}), "schedules")
        attributes = None
        if self.attributes is not None:
            tables = {OBSERVED: self.attributes, **self._attributes}
            attributes = reduce(DataFrame.unionByName, [t.select(F.lit(m).alias("model"), F.col("pid").cast(sched.schema["pid"].dataType).alias("pid"), "label", "cat") for m, t in tables.items()])
            attributes = stored(attributes, "attributes")
        members = stored(features.memberships(sched, attributes), "members")
        desc, dist = [], []
        if jobs.all_features:
            d, s = density_rows(sched, members, models, jobs)
            desc.append(d)
            dist.append(s)
        cells = members.where(F.col("model") == OBSERVED).groupBy("label", "cat").agg(F.count("*").alias("observed_n"))
        everybody = F.explode(F.array(*[F.lit(m) for m in (OBSERVED, *models)])).alias("model")
        # Creativity divides by the persons that attributes list, whether they have a schedule or not.
        listed = members if attributes is None else members.where(F.col("model") == OBSERVED).select("model", "pid", "label", "cat").unionByName(attributes.where(F.col("model") != OBSERVED))
        n = listed.groupBy("model", "label", "cat").agg(F.count("*").alias("n"))
        sizes = cells.select("label", "cat", everybody).join(n, ["model", "label", "cat"], "left").select("model", "label", "cat", F.coalesce("n", F.lit(0)).alias("n"))
        placed = None
        if jobs.creativity or jobs.needs_novel:
            placed = structure.signatures(sched).join(members.select("model", "pid", "label", "cat"), ["model", "pid"])
            placed = stored(placed, "signatures")
        if jobs.creativity:
            d, s = creativity_rows(sched, sizes, placed, jobs)
            desc.append(d)
            dist.append(_with_observed_weight(s))
        if jobs.home_based or jobs.consecutive or jobs.needs_novel:
            rows = feasibility_rows(sched, members, placed, jobs, sizes)
            desc.append(rows)
            dist.append(_with_observed_weight(rows))
        if not desc:
            raise ValueError("all jobs are switched off")
        raw = [stored(reduce(DataFrame.unionByName, x), "raw") for x in (desc, dist)]
        return EvalResult(raw[0], raw[1], models, bool(self.split_on))


def compare(observed: object, synthetic: object, order_col: str | None = None, jobs: Jobs | None = None) -> EvalResult:
    """Compare one synthetic population, or several by name, with an observed one."""
    models = synthetic if isinstance(synthetic, Mapping) else {"synthetic": synthetic}
    return Evaluator(observed, jobs=jobs, order_col=order_col).compare(models)


def compare_splits(observed: object, synthetic_schedules: Mapping[str, object], synthetic_attributes: Mapping[str, object], target_attributes: object, split_on: list[str], jobs: Jobs | None = None) -> EvalResult:
    """Compare within each category of the split columns."""
    return Evaluator(observed, target_attributes, split_on, jobs=jobs).compare(synthetic_schedules, synthetic_attributes)


def evaluate(synthetic_schedules: Mapping[str, object], target_schedules: object, report_stats: bool = True, verbose: bool = False) -> EvalResult:
    """Deprecated: compare() with its arguments the other way round."""
    warnings.warn("evaluate() will go, use compare()", DeprecationWarning, stacklevel=2)
    return compare(target_schedules, synthetic_schedules)


def subsample_and_evaluate(synthetic_schedules: Mapping[str, object], synthetic_attributes: Mapping[str, object], target_schedules: object, target_attributes: object, split_on: list[str], report_stats: bool = True, verbose: bool = False) -> EvalResult:
    """Deprecated: compare_splits() with its arguments in another order."""
    warnings.warn("subsample_and_evaluate() will go, use compare_splits()", DeprecationWarning, stacklevel=2)
    return compare_splits(target_schedules, synthetic_schedules, synthetic_attributes, target_attributes, split_on)
