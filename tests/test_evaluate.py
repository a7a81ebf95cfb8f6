"""Whole comparisons."""

import warnings

import pandas as pd
import pytest

import daymosaic
from daymosaic import Evaluator, Jobs, SplitNotAvailableError, compare, compare_splits, list_features
from daymosaic.plans import report
from daymosaic.plans.jobs import FEATURES, get_jobs, jobs_from_config


def rows(text):
    """'home 0 8, work 8 16; ...' as a table; persons are set apart by semicolons."""
    out = []
    for pid, person in enumerate(text.split(";")):
        for step in person.split(","):
            act, start, end = step.split()
            out.append((pid, act, float(start), float(end)))
    return pd.DataFrame(out, columns=["pid", "act", "start", "end"])


OBSERVED = rows("home 0 8, work 8 16, home 16 24; home 0 12, shop 12 13, home 13 24")
SYNTHETIC = rows("home 0 9, work 9 17, home 17 24; home 0 8, work 8 16, home 16 24; home 0 8, home 8 24")


@pytest.fixture(scope="module")
def result(spark):
    return compare(OBSERVED, {"m": SYNTHETIC})


def test_quick_start_numbers(result):
    got = {r["domain"]: r["m"] for r in result.summary().collect()}
    assert got == pytest.approx({"creativity": 1 / 6, "feasibility": 1 / 3, "participations": 0.162037, "timing": 0.082728, "transitions": 0.380952}, abs=1e-6)


def test_views_ranks_and_files(result, tmp_path):
    assert result.model_names == ["m"] and result.best_model == "m" and not result.has_splits
    assert result.groups.combined.descriptions.columns == ["domain", "feature", "observed", "m", "unit"]
    with pytest.raises(SplitNotAvailableError):
        _ = result.groups.by_attribute
    result.save(tmp_path)
    assert {p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.csv")} == {f"{a}/{b}.csv" for a in ("features", "groups", "domains") for b in ("descriptions", "distances")}
    assert "domains distances" in report.report(result, first=1, ranking=True)
    assert report.add_stats(result.summary(), ["m"]).first()["std"] is None


def test_absent_activity_is_the_greatest_timing_distance(spark):
    r = compare(rows("home 0 6, work 6 14, home 14 24; home 0 24"), {"m": rows("home 0 6, shop 6 14, home 14 24")})
    dist = {(x["feature"], x["segment"]): x["m"] for x in r.features.combined.distances.where("domain = 'timing'").collect()}
    assert dist[("start times", "work0")] == 1.0 and dist[("start-durations", "work")] == 1.0
    desc = {(x["feature"], x["segment"]): x["m"] for x in r.features.combined.descriptions.collect()}
    assert desc[("start times", "work0")] == 0.0
    rates = {x["segment"]: x["m"] for x in r.features.combined.distances.where("feature = 'participation rate'").collect()}
    assert rates["work"] == 0.5 and rates["shop"] is None


def test_equal_populations_have_no_distance_but_conservatism(spark):
    got = {r["domain"]: r["m"] for r in compare(OBSERVED, {"m": OBSERVED}).summary().collect()}
    assert got["participations"] == got["transitions"] == got["timing"] == 0 and got["creativity"] == 0.5


@pytest.fixture(scope="module")
def split(spark):
    attrs = pd.DataFrame({"pid": [0, 1], "gender": ["f", "m"]})
    more = pd.DataFrame({"pid": [0, 1, 2], "gender": ["f", "m", "x"]})
    return compare_splits(OBSERVED, {"m": SYNTHETIC}, {"m": more}, attrs, ["gender"])


def test_splits(split):
    assert split.has_splits
    cats = {r["cat"] for r in split.groups.by_category.distances.collect()}
    assert cats == {"f", "m"}
    # In category f, one person each: home-work-home on both sides.
    f = {(r["feature"]): r["m"] for r in split.groups.by_category.distances.where("cat = 'f'").collect()}
    assert f["2-gram"] == 0 and f["start times"] > 0
    # The observed person of m never works: the segment stays with weight 0, so the model's work counts by half.
    m = {(r["segment"], r["cat"]): r["m"] for r in split.features.by_category.distances.where("feature = 'start times'").collect()}
    assert m[("work0", "m")] == 1.0


def test_adding_models_one_by_one_is_the_same(spark):
    jobs = Jobs(tuple(f for f in FEATURES if f.name in ("lengths", "2-gram")))
    e = Evaluator(OBSERVED, jobs=jobs)
    both = e.compare({"a": SYNTHETIC, "b": OBSERVED}).summary().toPandas()
    e.reset()
    e.compare_population("a", SYNTHETIC)
    e.compare_population("b", OBSERVED)
    pd.testing.assert_frame_equal(e.report().summary().toPandas(), both)
    assert "persons   : 2" in repr(e)


def test_arguments_are_checked(spark):
    attrs = pd.DataFrame({"pid": [0, 1], "g": ["a", "b"]})
    with pytest.raises(ValueError, match="together"):
        Evaluator(OBSERVED, attrs)
    with pytest.raises(ValueError, match="not found"):
        Evaluator(OBSERVED, attrs, ["other"])
    with pytest.raises(ValueError, match="pid"):
        Evaluator(OBSERVED, attrs.drop(columns="pid"), ["g"])
    e = Evaluator(OBSERVED, attrs, ["g"])
    with pytest.raises(ValueError, match="required"):
        e.compare_population("m", SYNTHETIC)
    with pytest.raises(ValueError, match="not found"):
        e.compare_population("m", SYNTHETIC, attrs.drop(columns="g"))
    with pytest.raises(ValueError, match="need"):
        Evaluator(OBSERVED).compare({"m": SYNTHETIC}, {"m": attrs})


def test_numeric_splits_are_binned(spark):
    from daymosaic.operators.splits import category, numeric_edges

    ages = spark.createDataFrame([(i, 20.0 + 5 * i, i % 2) for i in range(10)], "pid long, age double, employed int")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        edges = numeric_edges(ages, ["age", "employed"])
    assert list(edges) == ["age"] and any("numeric" in str(w.message) for w in caught)
    got = [r[0] for r in ages.select(category("age", edges)).collect()]
    assert got == ["lowest"] * 2 + ["low"] * 2 + ["mid"] * 2 + ["high"] * 2 + ["highest"] * 2
    other = spark.createDataFrame([(99.0,), (None,), (1.0,)], "age double")
    assert [r[0] for r in other.select(category("age", edges)).collect()] == ["highest", "nan", "lowest"]


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[ngrams]\nmin_count = 5\n[jobs.participations]\nlengths = false\n[jobs.structural]\nhome_based = false\n")
    jobs = get_jobs(f)
    assert jobs.min_count == 5 and not jobs.home_based and "lengths" not in {x.name for x in jobs.features}
    assert "full sequences" in {x.name for x in jobs.features}  # what isn't mentioned is on
    assert not jobs_from_config({}).home_based_novel
    assert len(get_jobs().features) == 10


def test_catalogue(spark):
    table = list_features(spark)
    assert table.count() == 17 and table.where("in_default_config").count() == 10
    assert set(daymosaic.__all__) <= set(dir(daymosaic))


def test_hooks_replace_weights_descriptions_and_distances(spark):
    """A feature with functions of its own: each is given the feature's histograms, and the other features stay as they are."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from daymosaic.operators.features import CELL

    cell = [F.col(c) for c in CELL]
    (lengths,) = [f for f in FEATURES if f.name == "lengths"]
    own = replace(
        lengths, size=lambda h: h.groupBy(*cell).agg((F.sum("w") * 10).alias("weight")),
        describe_by=lambda h: h.groupBy(*cell).agg(F.max("v1").alias("value")),
        distance=lambda h: h.groupBy(*cell).agg((F.sum("wb") - F.sum("wa")).cast("double").alias("value")),
    )
    (rate,) = [f for f in FEATURES if f.name == "participation rate"]
    plain, hooked = (compare(OBSERVED, {"m": SYNTHETIC}, jobs=Jobs((f, rate), diversity=False, novelty=False, home_based=False, consecutive=False)) for f in (lengths, own))
    rows = lambda r, name: {(x["segment"], x["model"]): (x["value"], x["weight"]) for x in r.raw[name].where("feature = 'lengths'").collect()}
    assert {model: found for (_, model), found in rows(hooked, "descriptions").items()} == {"observed": (3.0, 20), "m": (3.0, 30)}
    assert {v[0] for v in rows(hooked, "distances").values()} == {1.0}
    others = lambda r: sorted(tuple(x) for x in r.raw["distances"].where("feature <> 'lengths'").select("segment", "value", "weight").collect())
    assert others(plain) == others(hooked) != []


def test_deprecated_names_give_the_same(spark, result):
    with pytest.warns(DeprecationWarning):
        old = daymosaic.evaluate({"m": SYNTHETIC}, OBSERVED)
    assert old.summary().collect() == result.summary().collect()
    groups = pd.DataFrame({"pid": [0, 1, 2], "g": ["x", "y", "x"]})
    with pytest.warns(DeprecationWarning):
        old = daymosaic.subsample_and_evaluate({"m": SYNTHETIC}, {"m": groups}, OBSERVED, groups[:2], ["g"])
    new = compare_splits(OBSERVED, {"m": SYNTHETIC}, {"m": groups}, groups[:2], ["g"])
    assert old.domains.by_category.distances.collect() == new.domains.by_category.distances.collect()


def test_averages_over_wide_tables(spark):
    wide = spark.createDataFrame([(1.0, 2, 3.0, 1, 4), (3.0, 6, 5.0, 3, 0)], "a double, a__weight int, b double, b__weight int, observed__weight int")
    assert report.weighted_average(wide) == {"a": 2.5, "b": 4.5}
    assert report.distance_weighted_average(wide) == pytest.approx({"a": (1 * 3 + 3 * 3) / 6, "b": (3 * 2.5 + 5 * 1.5) / 4})


def test_heaviest_segments_stand_first(result):
    """Rows of a feature are in the order of their observed weight, then of their description."""
    weight = {(r["feature"], r["segment"]): r["weight"] for r in result.raw["descriptions"].where("model = 'observed'").collect()}
    rows = result.features.combined.descriptions.collect()
    assert [c for c in result.features.combined.descriptions.columns if c.startswith("_")] == []
    for feature in ("start times", "participation rate"):
        own = [(-weight[feature, r["segment"]], -r["observed"], r["segment"]) for r in rows if r["feature"] == feature]
        assert len(own) > 2 and own == sorted(own)
    assert [(r["domain"], r["feature"]) for r in rows] == sorted((r["domain"], r["feature"]) for r in rows)
