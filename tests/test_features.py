"""Golden histograms of small schedules."""

import pytest
from pyspark.sql import functions as F

from daymosaic.operators import features, frequency
from daymosaic.plans.jobs import FEATURES, Jobs
from daymosaic.schema import canonical

NAMED = {f.name: f for f in FEATURES}
ACTS = [(0, "home", 0, 2), (0, "work", 2, 6), (0, "home", 6, 8), (1, "home", 0, 1), (1, "work", 1, 8)]


def schedules(spark, rows):
    df = spark.createDataFrame([(p, a, float(s), float(e)) for p, a, s, e in rows], "pid long, act string, start double, end double")
    return canonical(df.coalesce(1)).withColumn("model", F.lit("m"))


def hist(spark, rows, name, **options):
    jobs = Jobs((NAMED[name],), **{"min_count": 0, "day": 1.0, "bin": 1.0, **options})
    sched = schedules(spark, rows)
    counts = features.value_counts(features.feature_rows(sched, jobs))
    out = features.histograms(counts, features.segments(sched, counts, jobs), features.memberships(sched), jobs)
    got = {}
    for r in out.collect():
        v = r["v1"] if r["v2"] is None else (r["v1"], r["v2"])
        got.setdefault(r["segment"], {})[v] = r["w"]
    return got


@pytest.mark.parametrize(("name", "want"), [
    ("lengths", {"sequence lengths": {3: 1, 2: 1}}),
    ("participation rate", {"home": {2: 1, 1: 1}, "work": {1: 2}}),
    ("pair participation rate", {"home+home": {1: 1, 0: 1}, "home+work": {0: 2}, "work+work": {0: 2}}),
    ("seq participation rate", {"0home": {1: 2}, "1work": {1: 2}, "2home": {0: 1, 1: 1}}),
    ("enum participation rate", {"home0": {1: 2}, "work0": {1: 2}, "home1": {0: 1, 1: 1}}),
    ("2-gram", {"home>work": {1: 2}, "work>home": {0: 1, 1: 1}}),
    ("3-gram", {"home>work>home": {1: 1}}),
    ("full sequences", {"h>w>h": {1: 1, 0: 1}, "h>w": {1: 1, 0: 1}}),
    ("start times", {"home0": {0: 2}, "home1": {6: 1}, "work0": {2: 1, 1: 1}}),
    ("start times by act", {"home": {0.5: 2, 6.5: 1}, "work": {1.5: 1, 2.5: 1}}),
    ("end times by act", {"home": {1.5: 1, 2.5: 1, 8.5: 1}, "work": {6.5: 1, 8.5: 1}}),
    ("durations by act", {"home": {1.5: 1, 2.5: 2}, "work": {4.5: 1, 7.5: 1}}),
    ("start-durations", {"home": {(0.5, 1.5): 1, (0.5, 2.5): 1, (6.5, 2.5): 1}, "work": {(1.5, 7.5): 1, (2.5, 4.5): 1}}),
    ("joint-durations", {"home": {(2.5, 4.5): 1, (1.5, 7.5): 1}, "work": {(4.5, 2.5): 1}}),
])
def test_histograms(spark, name, want):
    assert hist(spark, ACTS, name) == want


def test_four_grams_leave_out_short_schedules(spark):
    rows = [(0, a, i, i + 1) for i, a in enumerate(["home", "work", "home", "home"])] + [(1, a, i, i + 1) for i, a in enumerate(["home", "work", "work"])]
    assert hist(spark, rows, "4-gram") == {"home>work>home>home": {1: 1}}


def test_bins_of_four(spark):
    got = hist(spark, ACTS, "start-durations", bin=4.0)
    assert got == {"home": {(2, 2): 2, (6, 2): 1}, "work": {(2, 6): 2}} or got["work"] == {(2, 6): 1, (2, 6.0): 1}


def test_time_consistency(spark):
    rows = [(0, "a", 0, 10), (0, "b", 10, 20), (0, "c", 20, 30), (1, "a", 0, 10), (1, "b", 10, 20)]
    assert hist(spark, rows, "time consistency", day=30.0) == {"starts at 0": {1: 2}, "ends at 30": {0: 1, 1: 1}, "duration is 30": {0: 1, 1: 1}}


def test_rare_ngrams_need_a_large_population(spark):
    rows = [(p, a, i, i + 1) for p in range(12) for i, a in enumerate(["home", "work"] if p else ["home", "shop"])]
    assert set(hist(spark, rows, "2-gram", min_count=3, min_count_trigger=10)) == {"home>work"}
    assert set(hist(spark, rows, "2-gram", min_count=3, min_count_trigger=12)) == {"home>work", "home>shop"}


def test_activity_counts_over_time(spark):
    sched = schedules(spark, [(0, "home", 0, 1), (0, "work", 1, 2), (0, "home", 2, 3), (1, "home", 0, 1), (1, "work", 1, 3)])
    got = {(r["bin"], r["act"]): (r["count"], r["density"]) for r in frequency.binned_counts(sched, 3, 1).collect()}
    assert got == {(0, "home"): (2, 1.0), (0, "work"): (0, 0.0), (1, "home"): (0, 0.0), (1, "work"): (2, 1.0), (2, "home"): (1, 0.5), (2, "work"): (1, 0.5)}
    assert frequency.count_schedules(sched).first()["value"] == 2


def test_uncovered_time_is_the_first_activity(spark):
    sched = schedules(spark, [(0, "work", 1, 2)])
    assert {(r["bin"], r["count"]) for r in frequency.binned_counts(sched, 3, 1).collect()} == {(0, 1), (1, 1), (2, 1)}


def test_custom_features(spark):
    from daymosaic.plans.jobs import Feature

    def acts(sched):
        one = sched.groupBy("model", "pid").agg(F.count_distinct("act").cast("double").alias("v1"))
        return one.select("model", "pid", F.lit("distinct").alias("segment"), F.array().cast("array<string>").alias("acts"), "v1", F.lit(None).cast("double").alias("v2"))

    jobs = Jobs((), extra=(Feature("own", "distinct acts", "own", "own", "n", "", True, "all", fn=acts),))
    sched = schedules(spark, ACTS)
    counts = features.value_counts(features.feature_rows(sched, jobs))
    assert {(r["v1"], r["w"]) for r in counts.collect()} == {(2.0, 2)}


def test_shares_of_sequences_add_up_from_the_rarest(spark):
    from pyspark.sql import functions as F

    from daymosaic.operators import frequency

    df = spark.createDataFrame([(p, s, a) for p, acts in enumerate(["hwh", "hwh", "hwh", "hs", "hs", "w", "x"]) for s, a in enumerate(acts)], "pid long, seq int, act string")
    got = {r["sequence"]: (r["persons"], r["share"], r["upto"]) for r in frequency.sequence_shares(df).collect()}
    assert got == {"h>w>h": (3, 3 / 7, 1.0), "h>s": (2, 2 / 7, 4 / 7), "w": (1, 1 / 7, 2 / 7), "x": (1, 1 / 7, 1 / 7)}
    assert frequency.sequence_shares(df.limit(0)).count() == 0 and F is not None


def test_rows_of_classes(spark):
    from daymosaic.operators import frequency

    df = spark.createDataFrame([(0, 0, "home", 0, 2), (0, 1, "work", 2, 4), (1, 0, "work", 1, 3)], "pid long, seq int, act string, start int, end int")
    rows = {r["pid"]: r["classes"] for r in frequency.one_hot(df, 4, 1).collect()}
    assert rows == {0: [[1, 0], [1, 0], [0, 1], [0, 1]], 1: [[1, 0], [0, 1], [0, 1], [1, 0]]}
    assert {r["pid"]: r["classes"] for r in frequency.down_sampled(frequency.one_hot(df, 4, 1), 2).collect()} == {0: [[1, 0], [0, 1]], 1: [[1, 0], [0, 1]]}
    assert {len(r["classes"][0]) for r in frequency.one_hot(df, 4, 2, ["work", "home", "shop"]).collect()} == {3}
