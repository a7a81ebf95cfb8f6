"""Structural checks, filters, files, the command line, the generator and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daymosaic import cli
from daymosaic.operators import structure
from daymosaic.plans.jobs import FEATURES, Jobs
from daymosaic.schema import canonical
from daymosaic.sources import files
from daymosaic.sources.generate import PROFILES, PopulationGenerator
from daymosaic.streaming import increment


def plans(text):
    out = []
    for pid, acts in enumerate(text.split(";")):
        out += [(pid, a, i, i + 1) for i, a in enumerate(acts.split(","))]
    return pd.DataFrame(out, columns=["pid", "act", "start", "end"])


def test_feasibility(spark):
    sched = canonical(plans("home,work,home;home,home;home,work,shop"), spark=spark).withColumn("model", F.lit("m"))
    rows = structure.rates(structure.flags(sched), structure.rate_rows(True, True), ["model"]).collect()
    got = {(r["feature"], r["segment"]): r["value"] for r in rows}
    third = pytest.approx(1 / 3)
    assert got == {("invalid", "all"): pytest.approx(2 / 3), ("not home based", "all"): third, ("not home based", "starts"): 0, ("not home based", "ends"): third, ("consecutive", "all"): third, ("consecutive", "home"): third, ("consecutive", "work"): 0, ("consecutive", "education"): 0}


def test_order_of_rows_does_not_matter(spark):
    df = pd.DataFrame([(0, "home", 0, 480), (0, "home", 960, 1440), (0, "work", 480, 960)], columns=["pid", "act", "start", "end"])
    flags = structure.flags(canonical(df, spark=spark).withColumn("model", F.lit("m"))).first()
    assert not flags["invalid"]


def test_novel_keeps_duplicates(spark):
    base = canonical(plans("home,work;home,shop"), spark=spark)
    scenario = canonical(plans("home,work;home,gym;home,gym;shop"), spark=spark)
    assert {r["pid"] for r in structure.novel(scenario, base).collect()} == {1, 2, 3}
    assert structure.no_filter(scenario).count() == scenario.count()


def write(path, df):
    path.parent.mkdir(parents=True, exist_ok=True)
    df.to_csv(path, index=False) if path.suffix == ".csv" else df.to_parquet(path, index=False)
    return str(path)


def test_filters_of_the_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "s.csv", plans("home,work,home;work,home;home,work;home,home;home,shop,shop,home"))
    cli.main(["filter", "non-home-based", path, "-o", str(tmp_path / "out.csv")])
    assert set(pd.read_csv(tmp_path / "out.csv").pid) == {1, 2}
    cli.main(["filter", "consecutive", path, "--act", "shop"])
    assert "4,shop" in capsys.readouterr().out
    bad = write(tmp_path / "b.csv", pd.DataFrame({"pid": [1]}))
    with pytest.raises(SystemExit, match="act"):
        cli.main(["filter", "consecutive", bad])


def test_discovery(spark, tmp_path):
    a = plans("home,work,home")
    write(tmp_path / "b/version_2/x.parquet", a)
    write(tmp_path / "b/version_10/x.parquet", a)
    write(tmp_path / "a/s.csv", a)
    write(tmp_path / "a/t.csv", pd.DataFrame({"pid": [0], "g": ["x"]}))
    found = files.discover(spark, str(tmp_path))
    assert [f[0] for f in found] == ["a", "b"] and "version_10" in found[1][1] and found[0][2] is None
    with pytest.raises(files.InputError, match="missing"):
        files.discover(spark, str(tmp_path), need_attributes=True)
    write(tmp_path / "a/u.csv", a)
    with pytest.raises(files.InputError, match="multiple"):
        files.discover(spark, str(tmp_path))


def test_files_of_unknown_kind_are_refused(spark, tmp_path):
    write(tmp_path / "a/s.csv", plans("home,work,home"))
    write(tmp_path / "a/notes.csv", pd.DataFrame({"x": [1]}))
    with pytest.raises(files.InputError, match="notes.csv"):
        files.discover(spark, str(tmp_path))


def test_large_tables_are_written_as_one_file(spark, tmp_path):
    path = tmp_path / "deep/out.csv"
    for n in (500, 0):  # an existing file is replaced
        files.write_csv(spark.range(n).repartition(4).selectExpr("id", "concat('a,', id) as t"), str(path))
        assert sorted(pd.read_csv(path)["id"]) == list(range(n)) and [p.name for p in path.parent.glob("[!.]*")] == ["out.csv"]


def test_comparison_on_the_command_line(spark, tmp_path, capsys):
    target = write(tmp_path / "t.csv", plans("home,work,home;home,shop,home"))
    model = write(tmp_path / "m.parquet", plans("home,work,home;home,home").assign(duration=1).drop(columns="end"))
    attrs = write(tmp_path / "a.csv", pd.DataFrame({"pid": [0, 1], "g": ["x", "y"]}))
    config = tmp_path / "c.toml"
    off = "\n".join(f"[jobs.{s}]\n" + "\n".join(f'"{f.key}" = {str(f.name in ("lengths", "2-gram")).lower()}' for f in FEATURES if f.section == s) for s in dict.fromkeys(f.section for f in FEATURES))
    config.write_text(off)
    cli.main([target, attrs, "-m", "one", model, attrs, "-s", "g", "-c", str(config), "-o", str(tmp_path / "out")])
    out = capsys.readouterr().out
    assert "Best model: one" in out and (tmp_path / "out/domains_by_category/distances.csv").exists()
    for argv, message in (([target], "required"), ([target, "-m", "one", model, "-b", "x"], "exclusive"), ([target, "-m", "one", model, "-s", "g"], "TARGET_ATTRS"), ([target, attrs, "-m", "one", model], "missing"), ([target, "-m", "one", model, attrs], "target attributes"), ([target, "-m", "one"], "takes"), ([target, "-m", "a", model, "-m", "a", model], "duplicate")):
        with pytest.raises(SystemExit, match=message):
            cli.main(argv)


def test_generator(spark):
    g = PopulationGenerator({"office": 50.0}, seed=3)
    df = g(spark, 300)
    assert canonical(df).groupBy("pid").agg(F.sum("duration").alias("d")).where("d <> 1440").count() == 0
    lunches = df.where("act = 'eat_out'").count()
    assert 200 < lunches < 300 and df.where("duration < 0").count() == 0
    assert df.exceptAll(g(spark, 300)).isEmpty()
    assert set(PopulationGenerator().shares) == set(PROFILES)
    with pytest.raises(ValueError, match="unknown"):
        PopulationGenerator({"x": 1.0})


def test_streamed_histograms_equal_those_of_everything(spark, tmp_path):
    from daymosaic.operators import features

    jobs = Jobs(tuple(f for f in FEATURES if f.name in ("participation rate", "2-gram", "start times")), min_count=3)
    everything = PopulationGenerator()(spark, 40).select("pid", "act", "start", "end").persist()
    for part in range(2):
        everything.where(F.col("pid") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    increment.accumulate(stream, str(tmp_path / "out"), str(tmp_path / "mark"), jobs, once=True).awaitTermination()
    got = increment.totals(spark, str(tmp_path / "out"), jobs)
    sched = canonical(everything).withColumn("model", F.lit("m"))
    counts = features.value_counts(features.feature_rows(sched, jobs))
    want = features.histograms(counts, features.segments(sched, counts, jobs), features.memberships(sched), jobs)
    columns = ["fid", "segment", "v1", "v2", "w"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and want.select(columns).exceptAll(got.select(columns)).isEmpty()
