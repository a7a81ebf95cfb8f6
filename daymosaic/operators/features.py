"""Features of schedules as rows (model, pid, fid, segment, acts, v1, v2), and their histograms.

All features of episodes come from one windowed pass (one shuffle by person) and one explode. Persons without a segment
are never materialised: a histogram's zero bucket is the number of persons less those with a value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.jobs import Feature, Jobs

ROW = ["model", "pid", "fid", "segment", "acts", "v1", "v2"]
CELL = ["model", "label", "cat", "fid", "segment"]
#: Label and category of everybody when there are no splits.
NO_SPLIT, EVERYBODY = "__split__", "all"
#: Episodes of a task that makes the values of all features.
EPISODES = 50_000


def bin_value(x: Column, width: float) -> Column:
    """Centre of the bin that holds x."""
    return F.floor(x / width) * width + width / 2


def episodes(sched: DataFrame) -> DataFrame:
    """Adds pos (from 0), k (earlier episodes of the activity), len, and what follows: a1, a2, a3, d1."""
    own, ordered = Window.partitionBy("model", "pid"), Window.partitionBy("model", "pid").orderBy("seq")
    out = sched.withColumns({
        "pos": F.row_number().over(ordered) - 1, "len": F.count("*").over(own),
        "a1": F.lead("act", 1).over(ordered), "a2": F.lead("act", 2).over(ordered), "a3": F.lead("act", 3).over(ordered), "d1": F.lead("duration").over(ordered),
    })
    return out.withColumn("k", F.row_number().over(Window.partitionBy("model", "pid", "act").orderBy("seq")) - 1)


def _entry(fid: int, segment: Column, acts: Column, v1: Column | None = None, v2: Column | None = None, when: Column | None = None) -> Column:
    null = F.lit(None).cast("double")
    entry = F.struct(F.lit(fid).alias("fid"), segment.alias("segment"), acts.alias("acts"), (null if v1 is None else v1).alias("v1"), (null if v2 is None else v2).alias("v2"))
    return entry if when is None else F.when(when, entry)


def _episode_entry(f: Feature, fid: int, jobs: Jobs) -> Column | None:
    """What an episode adds to a feature: an occurrence (v1 null) or a value."""
    act, own = F.col("act"), F.array("act")
    scaled = lambda c: F.col(c) / jobs.day
    binned = lambda c: bin_value(F.col(c), jobs.bin) / jobs.day
    nth = F.concat(act, F.col("k").cast("string"))
    if f.name == "lengths":
        return _entry(fid, F.lit("sequence lengths"), F.array().cast("array<string>"))
    if f.name == "participation rate":
        return _entry(fid, act, own)
    if f.name == "seq participation rate":
        return _entry(fid, F.concat(F.col("pos").cast("string"), act), own)
    if f.name == "enum participation rate":
        return _entry(fid, nth, own)
    if f.section == "transitions":
        n = int(f.name[0])
        steps = [F.col(c) for c in ("act", "a1", "a2", "a3")[:n]]
        return _entry(fid, F.concat_ws(">", *steps), F.array(*steps), when=steps[-1].isNotNull())
    if f.name == "start times":
        return _entry(fid, nth, own, scaled("start"))
    if f.name == "durations":
        return _entry(fid, nth, own, scaled("duration"))
    if f.name == "start-durations":
        return _entry(fid, act, own, binned("start"), binned("duration"))
    if f.name == "joint-durations":
        return _entry(fid, act, own, binned("duration"), binned("d1"), when=F.col("a1").isNotNull())
    if f.section == "timing" and f.name.endswith("by act"):
        return _entry(fid, act, own, binned({"start times by act": "start", "end times by act": "end", "durations by act": "duration"}[f.name]))
    return None


def _pairs(counts: DataFrame, fid: int) -> DataFrame:
    """Co-participation from (model, pid, act, n): pairs inside each person, values above 0."""
    acts = counts.groupBy("model", "pid").agg(F.array_sort(F.collect_list(F.struct("act", "n"))).alias("own"))
    pair = lambda a, b: F.struct(F.concat(a["act"], F.lit("+"), b["act"]).alias("segment"), F.array(a["act"], b["act"]).alias("acts"), F.floor(F.least(a["n"], b["n"]) / 2).cast("double").alias("v1"))
    pairs = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: a["act"] <= b["act"]), lambda b: pair(a, b))))
    return acts.select("model", "pid", F.explode(pairs).alias("p")).where("p.v1 > 0").select("model", "pid", F.lit(fid).alias("fid"), "p.segment", "p.acts", "p.v1", F.lit(None).cast("double").alias("v2"))


def _consistency(sched: DataFrame, fid: int, day: float) -> DataFrame:
    """Time consistency flags that hold."""
    ends = sched.groupBy("model", "pid").agg(F.min_by("start", "seq").alias("first"), F.max_by("end", "seq").alias("last"), F.sum("duration").alias("total"))
    end = f"{day:g}"
    flags = F.array(F.struct(F.lit("starts at 0").alias("segment"), (F.col("first") == 0).alias("ok")), F.struct(F.lit(f"ends at {end}").alias("segment"), (F.col("last") == day).alias("ok")), F.struct(F.lit(f"duration is {end}").alias("segment"), (F.col("total") == day).alias("ok")))
    return ends.select("model", "pid", F.explode(flags).alias("f")).where("f.ok").select("model", "pid", F.lit(fid).alias("fid"), "f.segment", F.array().cast("array<string>").alias("acts"), F.lit(1.0).alias("v1"), F.lit(None).cast("double").alias("v2"))


def _full_sequences(sched: DataFrame, fid: int) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("seq", "act")))
    own = sched.groupBy("model", "pid").agg(steps.alias("steps"))
    segment = F.array_join(F.transform("steps", lambda s: F.substring(s["act"], 1, 1)), ">")
    return own.select("model", "pid", F.lit(fid).alias("fid"), segment.alias("segment"), F.array_distinct(F.transform("steps", lambda s: s["act"])).alias("acts"), F.lit(1.0).alias("v1"), F.lit(None).cast("double").alias("v2"))


def dealt(sched: DataFrame) -> DataFrame:
    """Schedules dealt by person, so that a task gets some EPISODES episodes however many there are."""
    parts = -(-sched.count() // EPISODES)
    return sched.repartition(parts, "model", "pid") if parts > int(sched.sparkSession.conf.get("spark.sql.shuffle.partitions")) else sched


def feature_rows(sched: DataFrame, jobs: Jobs) -> DataFrame:
    """All values of all features: one row per person, feature and segment with a count, or per episode with a value."""
    sched = dealt(sched)
    features = jobs.all_features
    entries = [e for i, f in enumerate(features) if f.fn is None and (e := _episode_entry(f, i, jobs)) is not None]
    parts: list[DataFrame] = []
    if entries:
        made = episodes(sched.where("act is not null")).select("model", "pid", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("model", "pid", "e.*")
        counted = [i for i, f in enumerate(features) if f.zeros is not None]
        occurrences = made.where(F.col("fid").isin(counted)) if counted else None
        if occurrences is not None:
            n = occurrences.groupBy("model", "pid", "fid", "segment").agg(F.any_value("acts").alias("acts"), F.count("*").cast("double").alias("v1"))
            parts.append(n.withColumn("v2", F.lit(None).cast("double")))
        parts.append(made.where(~F.col("fid").isin(counted) & F.col("v1").isNotNull()) if counted else made.where("v1 is not null"))
    for i, f in enumerate(features):
        if f.fn is not None:
            parts.append(f.fn(sched).withColumn("fid", F.lit(i)))
        elif f.name == "pair participation rate":
            parts.append(_pairs(sched.where("act is not null").groupBy("model", "pid", "act").agg(F.count("*").alias("n")), i))
        elif f.name == "time consistency":
            parts.append(_consistency(sched, i, jobs.day))
        elif f.name == "full sequences":
            parts.append(_full_sequences(sched.where("act is not null"), i))
    return reduce(DataFrame.unionByName, [p.select(*ROW) for p in parts])


def memberships(sched: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(model, pid, len, label, cat) of persons with a schedule. attributes: (model, pid, label, cat)."""
    persons = sched.groupBy("model", "pid").agg(F.count("*").alias("len"))
    if attributes is None:
        return persons.withColumns({"label": F.lit(NO_SPLIT), "cat": F.lit(EVERYBODY)})
    return persons.join(attributes.select("model", "pid", "label", "cat").distinct(), ["model", "pid"])


def value_counts(rows: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(model, label, cat, fid, segment, v1, v2, w, acts) of the whole population and of each category of members."""
    if members is None:
        whole = rows.withColumns({"label": F.lit(NO_SPLIT), "cat": F.lit(EVERYBODY)})
        return whole.groupBy(*CELL, "v1", "v2").agg(F.count("*").alias("w"), F.any_value("acts").alias("acts"))
    # Rows are made and joined once: persons of equal categories are counted together, and the counts are dealt out.
    place = "array<struct<label:string,cat:string>>"
    own = members.groupBy("model", "pid").agg(F.array_sort(F.collect_set(F.struct("label", "cat"))).cast(place).alias("cats"))
    together = rows.join(own, ["model", "pid"], "left").groupBy("model", "cats", "fid", "segment", "v1", "v2").agg(F.count("*").alias("w"), F.any_value("acts").alias("acts"))
    everybody = F.array(F.struct(F.lit(NO_SPLIT).alias("label"), F.lit(EVERYBODY).alias("cat"))).cast(place)
    dealt = together.withColumn("c", F.explode(F.concat(everybody, F.coalesce("cats", F.array().cast(place))))).drop("cats").select("*", "c.label", "c.cat")
    return dealt.groupBy(*CELL, "v1", "v2").agg(F.sum("w").alias("w"), F.any_value("acts").alias("acts"))


def segments(sched: DataFrame, counts: DataFrame, jobs: Jobs) -> DataFrame:
    """(model, fid, segment, acts): what a model's whole population has, rare n-grams left out."""
    features = jobs.all_features
    totals = counts.where(F.col("label") == NO_SPLIT).groupBy("model", "fid", "segment").agg(F.any_value("acts").alias("acts"), F.sum(F.col("v1") * F.col("w")).alias("total"))
    grams = [i for i, f in enumerate(features) if f.section == "transitions"]
    people = sched.groupBy("model").agg(F.count_distinct("pid").alias("persons"), F.array_sort(F.collect_set("act")).alias("all"))  # a row per model
    if jobs.min_count > 0 and grams:
        rare = F.col("fid").isin(grams) & (F.col("total") < jobs.min_count) & (F.col("persons") > jobs.min_count_trigger)
        totals = totals.join(F.broadcast(people), "model").where(~rare)
    out = [totals.select("model", "fid", "segment", "acts")]
    for i, f in enumerate(features):
        if f.name == "pair participation rate":  # also pairs that nobody has
            pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: a <= b), lambda b: F.array(a, b))))
            out.append(people.select("model", F.lit(i).alias("fid"), F.explode(pairs).alias("acts")).select("model", "fid", F.array_join("acts", "+").alias("segment"), "acts"))
        elif f.name == "time consistency":
            end = f"{jobs.day:g}"
            named = F.explode(F.array(F.lit("starts at 0"), F.lit(f"ends at {end}"), F.lit(f"duration is {end}")))
            out.append(people.select("model", F.lit(i).alias("fid"), named.alias("segment"), F.array().cast("array<string>").alias("acts")))
    return reduce(DataFrame.unionByName, out).dropDuplicates(["model", "fid", "segment"])


def histograms(counts: DataFrame, wanted: DataFrame, members: DataFrame, jobs: Jobs) -> DataFrame:
    """(model, label, cat, fid, segment, v1, v2, w) with zero buckets, for the wanted segments of each category."""
    features = jobs.all_features
    found = counts.join(wanted.select("model", "fid", "segment"), ["model", "fid", "segment"], "left_semi").select(*CELL, "v1", "v2", "w")
    bases = sorted({f.zeros for f in features if f.zeros is not None}, key=str)
    if not bases:
        return found
    sizes = members.groupBy("model", "label", "cat").agg(*[(F.count("*") if b == "all" else F.count_if(F.col("len") >= b)).alias(f"n_{b}") for b in bases])
    base = F.coalesce(*[F.when(F.col("fid").isin([i for i, f in enumerate(features) if f.zeros == b]), F.col(f"n_{b}")) for b in bases])
    counted = [i for i, f in enumerate(features) if f.zeros is not None]
    positive = found.where(F.col("fid").isin(counted)).groupBy(*CELL).agg(F.sum("w").alias("some"))
    zero = wanted.where(F.col("fid").isin(counted)).join(sizes, "model").withColumn("base", base).join(positive, CELL, "left")
    bucket = zero.withColumn("w", F.col("base") - F.coalesce("some", F.lit(0))).where("w > 0")
    null = F.lit(None).cast("double")
    return found.unionByName(bucket.select(*CELL, F.lit(0.0).alias("v1"), null.alias("v2"), "w"))


def described(hist: DataFrame) -> DataFrame:
    """(cell, weight, value): total weight and weighted mean; of planes, the sum of both components' means."""
    v = F.col("v1") + F.coalesce("v2", F.lit(0.0))
    return hist.groupBy(*CELL).agg(F.sum("w").alias("weight"), (F.sum(v * F.col("w")) / F.sum("w")).alias("value"))


def hooked(table: DataFrame, column: str, hist: DataFrame, features: Sequence[Feature], hook: str) -> DataFrame:
    """table (a row per cell) with the column that features' own functions give, where they have one."""
    for i, f in enumerate(features):
        own = getattr(f, hook)
        if own is not None:
            given = own(hist.where(F.col("fid") == i)).select(*CELL, F.col(column).alias("_own"))
            here = F.when(F.col("fid") == i, F.col("_own")).otherwise(F.col(column))
            table = table.join(given, CELL, "left").withColumn(column, here).drop("_own")
    return table


def feature_name(features: Sequence[Feature], attribute: str) -> Column:
    """A feature's attribute by its fid."""
    return F.element_at(F.array(*[F.lit(getattr(f, attribute)) for f in features]), F.col("fid") + 1)
