"""Signatures of whole schedules, and structural checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Activities whose immediate repetition makes a schedule infeasible.
NO_REPEATS = ("home", "work", "education")


def signatures(sched: DataFrame) -> DataFrame:
    """(model, pid, signature): activities and durations in order. Equal schedules, and only those, have equal ones."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "act", "duration")))
    own = sched.groupBy("model", "pid").agg(steps.alias("steps"))
    return own.select("model", "pid", F.to_json(F.transform("steps", lambda s: F.struct(s["act"].alias("a"), s["duration"].alias("d")))).alias("signature"))


def flags(sched: DataFrame, repeats: tuple[str, ...] = NO_REPEATS) -> DataFrame:
    """Per person: not_start, not_end, not_home_based, consecutive_<act>, consecutive, invalid."""
    before = F.lag("act").over(Window.partitionBy("model", "pid").orderBy("seq"))
    again = sched.withColumn("again", F.when(F.col("act") == before, F.col("act")))
    agg = [(F.min_by("act", "seq") != "home").alias("not_start"), (F.max_by("act", "seq") != "home").alias("not_end")]
    agg += [F.max(F.coalesce(F.col("again") == a, F.lit(False))).alias(f"consecutive_{a}") for a in repeats]
    out = again.groupBy("model", "pid").agg(*agg)
    any_repeat = F.lit(False)
    for a in repeats:
        any_repeat = any_repeat | F.col(f"consecutive_{a}")
    out = out.withColumns({"not_home_based": F.col("not_start") | F.col("not_end"), "consecutive": any_repeat})
    return out.withColumn("invalid", F.col("not_home_based") | F.col("consecutive"))


def rate_rows(home_based: bool, consecutive: bool, suffix: str = "") -> list[tuple[str, str, Column]]:
    """(feature, segment, condition) of the feasibility rows."""
    rows: list[tuple[str, str, Column]] = []
    if home_based or consecutive:
        invalid = F.lit(False)
        invalid = invalid | F.col("not_home_based") if home_based else invalid
        invalid = invalid | F.col("consecutive") if consecutive else invalid
        rows.append((f"invalid{suffix}", "all", invalid))
    if home_based:
        rows += [(f"not home based{suffix}", s, F.col(c)) for s, c in (("all", "not_home_based"), ("starts", "not_start"), ("ends", "not_end"))]
    if consecutive:
        rows += [(f"consecutive{suffix}", "all", F.col("consecutive"))] + [(f"consecutive{suffix}", a, F.col(f"consecutive_{a}")) for a in NO_REPEATS]
    return rows


def rates(people: DataFrame, rows: list[tuple[str, str, Column]], by: list[str]) -> DataFrame:
    """(by, feature, segment, value, weight): shares of persons for whom each condition holds, in one aggregate."""
    sums = people.groupBy(*by).agg(F.count("*").alias("weight"), *[F.sum(c.cast("int")).alias(f"c{i}") for i, (_, _, c) in enumerate(rows)])
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(s).alias("segment"), (F.col(f"c{i}") / F.col("weight")).alias("value")) for i, (f, s, _) in enumerate(rows)])
    return sums.select(*by, "weight", F.explode(entries).alias("e")).select(*by, "e.feature", "e.segment", "e.value", "weight")


def novel(sched: DataFrame, base: DataFrame) -> DataFrame:
    """Schedules (canonical, without model) whose signature base doesn't have; duplicates stay."""
    own, known = (signatures(x.withColumn("model", F.lit("x"))) for x in (sched, base))
    fresh = own.join(known.select("signature").distinct(), "signature", "left_anti").select("pid")
    return sched.join(fresh, "pid", "left_semi")


def no_filter(sched: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """All schedules."""
    return sched


def not_home_based(sched: DataFrame) -> DataFrame:
    """Schedules that don't begin and end at home."""
    bad = flags(sched.withColumn("model", F.lit("x"))).where("not_home_based").select("pid")
    return sched.join(bad, "pid", "left_semi")


def with_repeats(sched: DataFrame, acts: tuple[str, ...] = NO_REPEATS) -> DataFrame:
    """Schedules in which one of the activities follows itself."""
    before = F.lag("act").over(Window.partitionBy("pid").orderBy("seq"))
    bad = sched.withColumn("before", before).where((F.col("act") == F.col("before")) & F.col("act").isin(*acts)).select("pid").distinct()
    return sched.join(bad, "pid", "left_semi")
