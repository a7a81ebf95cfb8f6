"""Registered queries over the driver's tables. Their SQL is in sql.py, under the same names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, sinkhorn
from ..operators import emd, features, frequency, pairwise, splits, structure
from ..schema import OBSERVED
from ..sources import events
from ..storage import stored
from . import evaluate, report, tiers
from .jobs import FEATURES, Jobs, catalogue

Query = Callable[[SparkSession, str], DataFrame]
MODELS = ["model_a", "model_b"]
NAMED = {f.name: f for f in FEATURES}
LINES = tuple(f for f in FEATURES if f.default and f.dims == 1)


def _schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.schedules(spark, sf_dir).select("model", "pid", "act", "start", "end", "duration", "seq")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a day as one schedule, for operators on all pairs of schedules."""
    from pyspark.sql.window import Window

    e = events.schedules(spark, sf_dir)
    order = Window.partitionBy("d").orderBy("start", "user_id", "seq")
    return e.select(F.col("d").cast("long").alias("pid"), "act", "start", "end", "duration", F.row_number().over(order).alias("seq"))


def _parts(df: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    one = lambda m: df.where(F.col("model") == m).drop("model")
    return one(OBSERVED), {m: one(m) for m in MODELS}


def _histograms(spark: SparkSession, sf_dir: str, names: tuple[str, ...], min_count: int = 0) -> tuple[DataFrame, DataFrame, Jobs]:
    """(schedules, histograms, jobs) of some features, without splits."""
    jobs = Jobs(tuple(NAMED[n] for n in names), min_count=min_count)
    sched = _schedules(spark, sf_dir)
    counts = stored(features.value_counts(features.feature_rows(sched, jobs)), "counts")
    wanted = features.segments(sched, counts, jobs)
    return sched, features.histograms(counts, wanted, features.memberships(sched), jobs), jobs


def histogram(spark: SparkSession, sf_dir: str, name: str, min_count: int = 0) -> DataFrame:
    _, hist, jobs = _histograms(spark, sf_dir, (name,), min_count)
    plane = [F.round("v2", 9).alias("v2")] * (jobs.features[0].dims == 2)
    return hist.select("model", "segment", F.round("v1", 9).alias("v1"), *plane, F.col("w").cast("long").alias("w"))


def distances(spark: SparkSession, sf_dir: str, name: str, min_count: int = 0) -> DataFrame:
    """Earth mover's distance of each segment of one feature."""
    _, hist, jobs = _histograms(spark, sf_dir, (name,), min_count)
    hist = stored(hist, "histograms")
    have = lambda which: hist.where(which).groupBy(*features.CELL).agg(F.sum("w").alias("n"))
    other = F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")
    a = have(F.col("model") == OBSERVED).drop("model").select(other, "label", "cat", "fid", "segment", F.lit(True).alias("has_a"))
    b = have(F.col("model") != OBSERVED).select(*features.CELL, F.lit(True).alias("has_b"))
    keys = a.join(b, features.CELL, "full").fillna(False, ["has_a", "has_b"])
    return emd.scored(hist, keys, MODELS, jobs).select("model", "segment", F.round("value", 9).alias("emd"))


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and mean of every segment of the default features that have one dimension."""
    names = tuple(f.name for f in LINES)
    _, hist, jobs = _histograms(spark, sf_dir, names, 3)
    out = features.described(hist)
    return out.select("model", features.feature_name(jobs.features, "name").alias("feature"), "segment", F.col("weight").cast("long").alias("weight"), F.round("value", 9).alias("value"))


def _compared(spark: SparkSession, sf_dir: str, jobs: Jobs) -> evaluate.EvalResult:
    observed, models = _parts(stored(_schedules(spark, sf_dir), "log"))
    return evaluate.Evaluator(observed, jobs=jobs, order_col="seq").compare(models)


def compared(spark: SparkSession, sf_dir: str, level: str, jobs: Jobs) -> DataFrame:
    """Distances of a whole comparison at a level."""
    result = _compared(spark, sf_dir, jobs)
    out = getattr(result, level).combined.distances
    return out.select(*[c for c in out.columns if c not in (*MODELS, "unit")], *[F.round(m, 9).alias(m) for m in MODELS])


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _compared(spark, sf_dir, Jobs(LINES)).groups.combined.descriptions
    return out.select("domain", "feature", *[F.round(m, 9).alias(m) for m in (OBSERVED, *MODELS)])


def ranking(spark: SparkSession, sf_dir: str, jobs: Jobs) -> DataFrame:
    return _compared(spark, sf_dir, jobs).rank_models().select("model", F.round("distance", 9).alias("distance"))


def group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each model in each group."""
    rows = tiers.tier(_compared(spark, sf_dir, Jobs(LINES)).raw_distances, "groups", [], True)
    return report.ranked(rows.withColumn("value", F.round("value", 9)), ["domain", "feature"])


SPLIT_JOBS = Jobs(tuple(NAMED[n] for n in ("participation rate", "2-gram", "start times")))


def split_comparison(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """Groups within each market segment of the schedules' users."""
    observed, models = _parts(stored(_schedules(spark, sf_dir), "log"))
    attributes = stored(events.attributes(spark, sf_dir).select("pid", "segment"), "attributes")
    result = evaluate.Evaluator(observed, attributes.join(observed.select("pid").distinct(), "pid", "left_semi"), ["segment"], jobs=SPLIT_JOBS, order_col="seq").compare(models, {m: attributes.join(t.select("pid").distinct(), "pid", "left_semi") for m, t in models.items()})
    out = getattr(result.groups, view).distances
    return out.select(*[c for c in out.columns if c not in (*MODELS, "unit")], *[F.round(m, 9).alias(m) for m in MODELS])


def numeric_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules by quintile of their user's balance; edges come from the observed ones."""
    import warnings

    attributes = events.attributes(spark, sf_dir)
    own = attributes.join(_schedules(spark, sf_dir).where(F.col("model") == OBSERVED).select("pid").distinct(), "pid", "left_semi")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        edges = splits.numeric_edges(own, ["acctbal"])
    return attributes.select("pid", splits.category("acctbal", edges).alias("cat")).groupBy("cat").agg(F.count("*").alias("schedules"), F.min("pid").alias("first_pid"))


def feasibility_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structure.flags(_schedules(spark, sf_dir))
    return out.select("model", "pid", "invalid", "not_home_based", "not_start", "not_end", "consecutive", *[f"consecutive_{a}" for a in structure.NO_REPEATS])


def feasibility_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = structure.flags(_schedules(spark, sf_dir))
    out = structure.rates(people, structure.rate_rows(True, True), ["model"])
    return out.select("model", "feature", "segment", F.round("value", 9).alias("value"), "weight")


def feasibility_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shares among schedules that weren't observed."""
    sched = _schedules(spark, sf_dir)
    signs = structure.signatures(sched)
    known = signs.where(F.col("model") == OBSERVED).select("signature").distinct()
    fresh = signs.where(F.col("model") != OBSERVED).join(known, "signature", "left_anti").select("model", "pid")
    people = structure.flags(sched).join(fresh, ["model", "pid"], "left_semi")
    out = structure.rates(people, structure.rate_rows(True, True), ["model"])
    return out.select("model", "feature", "segment", F.round("value", 9).alias("value"), "weight")


def creativity(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    """Descriptions (0) or distances (1) of diversity and novelty."""
    sched = _schedules(spark, sf_dir)
    members = features.memberships(sched)
    placed = structure.signatures(sched).join(members.select("model", "pid", "label", "cat"), ["model", "pid"])
    sizes = members.groupBy("model", "label", "cat").agg(F.count("*").alias("n"))
    return evaluate.creativity_rows(sched, sizes, placed, Jobs())[which].select("model", "feature", F.round("value", 9).alias("value"), "weight")


def filtered(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Persons that a filter keeps, with their episodes."""
    sched = _schedules(spark, sf_dir)
    observed, models = _parts(sched)
    if which == "novel":
        out = structure.novel(models["model_a"], observed)
    elif which == "home":
        out = structure.not_home_based(sched.drop("model"))
    else:
        out = structure.with_repeats(sched.drop("model"))
    return out.groupBy("pid").agg(F.count("*").alias("episodes"))


def view_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedules(spark, sf_dir).select("model", "pid", "act", F.col("start").alias("start_t"), F.col("end").alias("end_t"), "duration", F.col("seq").cast("long").alias("seq"))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(_schedules(spark, sf_dir))[0]


def activity_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frequency.binned_counts(_observed(spark, sf_dir))
    return out.select(F.col("bin").cast("long").alias("bin"), "act", F.col("count").cast("long").alias("persons"), F.round("density", 9).alias("density"))


def time_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.time_use(_observed(spark, sf_dir)).select(F.col("minute").cast("long").alias("minute"), "act", F.round("share", 9).alias("share"))


def sequence_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.sequence_shares(_observed(spark, sf_dir)).select("sequence", "persons", F.round("share", 9).alias("share"))


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.bigram_matrix(_observed(spark, sf_dir)).select("act", "after", F.round("rate", 9).alias("rate"))


def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participation by activity next to first starts and total durations."""
    sched = _observed(spark, sf_dir)
    work = frequency.first_starts(sched, "work").agg(F.count("*").alias("persons"), F.avg("first").alias("first"), F.avg("total").alias("total")).withColumn("act", F.lit("work"))
    return frequency.participation_table(sched).join(work, "act", "left").select("act", F.round("rate", 9).alias("rate"), F.round("share", 9).alias("share"), "persons", F.round("first", 6).alias("first_start"), F.round("total", 6).alias("total_duration"))


def time_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.time_histogram(_observed(spark, sf_dir)).select("act", F.col("bin").cast("long").alias("bin"), "episodes")


def joint_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frequency.joint_histogram(_observed(spark, sf_dir))
    return out.select("act", F.col("start_bin").cast("long").alias("start_bin"), F.col("duration_bin").cast("long").alias("duration_bin"), "episodes")


def gantt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frequency.gantt_table(_observed(spark, sf_dir))
    return out.select("pid", "act", F.col("start").alias("start_t"), F.col("end").alias("end_t"), F.col("seq").cast("long").alias("seq"))


def schedule_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.count_schedules(_observed(spark, sf_dir))


def density_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of persons in an activity over the share of the day."""
    out = frequency.activity_frequencies(_observed(spark, sf_dir), density=True)
    return out.select("segment", F.round("value", 9).alias("value"), F.round("weight", 9).alias("weight"))


def lengths_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.length_table(_observed(spark, sf_dir))


def scalar_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalar distances between start histograms (half hours) of the observed and each model, by activity."""
    sched = _schedules(spark, sf_dir)
    hist = sched.groupBy("model", "act", (F.floor(F.col("start") / 30) * 30).cast("double").alias("v")).agg(F.count("*").alias("w"))
    other = F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")
    a = hist.where(F.col("model") == OBSERVED).select(other, "act", "v", F.col("w").alias("wa"), F.lit(0).cast("long").alias("wb"))
    b = hist.where(F.col("model") != OBSERVED).select("model", "act", "v", F.lit(0).cast("long").alias("wa"), F.col("w").alias("wb"))
    rows, keys = a.unionByName(b), ["model", "act"]
    out = scalar.weight_distances(rows, keys).join(scalar.mean_distances(rows, keys), keys).join(scalar.wasserstein(rows, keys), keys)
    return out.select("model", "act", *[F.round(c, 9).alias(c) for c in ("mae", "mse", "abs_av_diff", "mape", "distance")])


def pairs(spark: SparkSession, sf_dir: str, specs: Callable[[], list[pairwise.PairwiseSpec]]) -> DataFrame:
    """Distances between days, as the SQL has them; schedule_pairs compares the schedules themselves."""
    return pairwise.pairwise_distances(_days(spark, sf_dir), specs(), order_col="seq", digits=9).pairs


def schedule_pairs(spark: SparkSession, sf_dir: str, specs: Callable[[int], list[pairwise.PairwiseSpec]]) -> DataFrame:
    """Distances between all schedules; sequences are as long as the longest schedule. Rows grow with their square."""
    sched = _schedules(spark, sf_dir).drop("model")
    longest = sched.agg(F.max("seq")).first()[0] or 1
    return pairwise.pairwise_distances(sched, specs(longest), order_col="seq", digits=9).pairs


def sinkhorn_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the (start, duration) points of all episodes of the observed and of each model, by activity."""
    points = _schedules(spark, sf_dir).select("model", "act", F.array(F.col("start") / 1440, F.col("duration") / 1440).alias("x"))
    other = F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")
    a = points.where(F.col("model") == OBSERVED).select(other, "act", F.lit("a").alias("side"), "x")
    b = points.where(F.col("model") != OBSERVED).select("model", "act", F.lit("b").alias("side"), "x")
    return sinkhorn.sinkhorn(a.unionByName(b), ["model", "act"])


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliced Wasserstein distance of (start, duration) points, observed against each model."""
    points = _schedules(spark, sf_dir).select(F.col("model").alias("side"), F.array(F.col("start") / 1440, F.col("duration") / 1440).alias("x"))
    found = scalar.sliced_distances(points, OBSERVED, MODELS)
    rows = [(m, None if d is None else round(d, 9)) for m, d in found.items()]
    return spark.createDataFrame(rows, "model string, distance double")


def feature_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(catalogue(), "domain string, name string, config_key string, description string, in_default_config boolean")


ONE_DIMENSION = Jobs(LINES)
QUERIES: dict[str, Query] = {
    "schedule_view": view_of,
    "seq_lengths_hist": partial(histogram, name="lengths"),
    "participation_hist": partial(histogram, name="participation rate"),
    "pair_participation_hist": partial(histogram, name="pair participation rate"),
    "seq_rate_hist": partial(histogram, name="seq participation rate"),
    "enum_rate_hist": partial(histogram, name="enum participation rate"),
    "ngram2_hist": partial(histogram, name="2-gram"),
    "ngram3_hist": partial(histogram, name="3-gram"),
    "ngram4_hist": partial(histogram, name="4-gram"),
    "ngram_min_count": partial(histogram, name="4-gram", min_count=3),
    "full_sequence_hist": partial(histogram, name="full sequences"),
    "start_hist": partial(histogram, name="start times"),
    "duration_hist": partial(histogram, name="durations"),
    "start_duration_hist2d": partial(histogram, name="start-durations"),
    "joint_duration_hist2d": partial(histogram, name="joint-durations"),
    "start_by_act_hist": partial(histogram, name="start times by act"),
    "end_by_act_hist": partial(histogram, name="end times by act"),
    "duration_by_act_hist": partial(histogram, name="durations by act"),
    "time_consistency": partial(histogram, name="time consistency"),
    "feature_averages": averages,
    "emd1d_start": partial(distances, name="start times"),
    "emd1d_duration": partial(distances, name="durations"),
    "emd1d_participation": partial(distances, name="participation rate"),
    "emd1d_pair_participation": partial(distances, name="pair participation rate"),
    "emd1d_ngram2": partial(distances, name="2-gram", min_count=3),
    "emd1d_ngram4": partial(distances, name="4-gram", min_count=3),
    "emd2d_start_durations": partial(distances, name="start-durations"),
    "emd2d_joint_durations": partial(distances, name="joint-durations"),
    "feasibility_flags": feasibility_flags,
    "feasibility_rates": feasibility_rates,
    "feasibility_novel": feasibility_novel,
    "creativity_descriptions": partial(creativity, which=0),
    "creativity_distances": partial(creativity, which=1),
    "filter_novel": partial(filtered, which="novel"),
    "filter_non_home_based": partial(filtered, which="home"),
    "filter_consecutive": partial(filtered, which="repeats"),
    "split_numeric_bins": numeric_bins,
    "split_by_category": partial(split_comparison, view="by_category"),
    "split_by_attribute": partial(split_comparison, view="by_attribute"),
    "features_tier_1d": partial(compared, level="features", jobs=ONE_DIMENSION),
    "groups_tier_1d": partial(compared, level="groups", jobs=ONE_DIMENSION),
    "group_descriptions_1d": descriptions,
    "domains_tier_1d": partial(compared, level="domains", jobs=ONE_DIMENSION),
    "domains_tier": partial(compared, level="domains", jobs=Jobs()),
    "domains_tier_novel": partial(compared, level="domains", jobs=replace(ONE_DIMENSION, home_based_novel=True, consecutive_novel=True)),
    "rank_models": partial(ranking, jobs=ONE_DIMENSION),
    "rank_groups": group_ranks,
    "activity_density": activity_density,
    "time_use": time_use,
    "sequence_probs": sequence_probs,
    "bigram_matrix": bigrams,
    "participation_summary": describe_tables,
    "start_time_bins": time_histograms,
    "joint_time_bins": joint_bins,
    "gantt_rows": gantt_rows,
    "schedule_count": schedule_count,
    "density_curves": density_curves,
    "length_table": lengths_table,
    "scalar_distances": scalar_distances,
    "pairwise_default": partial(pairs, specs=pairwise.default_specs),
    "pairwise_participation_mae": partial(pairs, specs=lambda: pairwise.default_specs()[:1]),
    "pairwise_hamming": partial(pairs, specs=lambda: [pairwise.PairwiseSpec("hamming", pairwise.transition_vectors, pairwise.hamming)]),
    "pairwise_chamfer": partial(pairs, specs=lambda: [pairwise.chamfer_spec()]),
    "pairwise_soft_dtw": partial(pairs, specs=lambda: [pairwise.soft_dtw_spec()]),
    "pairwise_schedules_default": partial(schedule_pairs, specs=lambda n: pairwise.default_specs()),
    "pairwise_schedules_participation_mae": partial(schedule_pairs, specs=lambda n: pairwise.default_specs()[:1]),
    "pairwise_schedules_hamming": partial(schedule_pairs, specs=lambda n: [pairwise.PairwiseSpec("hamming", pairwise.transition_vectors, pairwise.hamming)]),
    "pairwise_schedules_chamfer": partial(schedule_pairs, specs=lambda n: [pairwise.chamfer_spec(n)]),
    "pairwise_schedules_soft_dtw": partial(schedule_pairs, specs=lambda n: [pairwise.soft_dtw_spec(n)]),
    "sinkhorn": sinkhorn_distances,
    "sliced_wasserstein": sliced,
    "feature_catalogue": feature_catalogue,
}
