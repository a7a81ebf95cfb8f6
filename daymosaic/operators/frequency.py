"""What people do over the day, and other tables that describe a population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import running, stored


def count_schedules(sched: DataFrame) -> DataFrame:
    """(segment, value, weight): the number of schedules."""
    return sched.agg(F.count_distinct("pid").cast("double").alias("value")).select(F.lit("all").alias("segment"), "value", F.lit(1).cast("long").alias("weight"))


def discretised(sched: DataFrame, duration: int = 1440, step: int = 15) -> DataFrame:
    """(pid, bin, act): the activity at each sampled time; of overlapping episodes the later one.

    An episode holds the times t = bin * step with start <= t < end; times without an episode are not listed.
    """
    last = F.lit(duration // step - 1)
    first = F.greatest(F.ceil(F.col("start") / step), F.lit(0)).cast("int")
    upto = F.least(F.ceil(F.col("end") / step) - 1, last).cast("int")
    spread = sched.withColumns({"first": first, "upto": upto}).where("first <= upto").select("pid", "seq", "act", F.explode(F.sequence("first", "upto")).alias("bin"))
    return spread.groupBy("pid", "bin").agg(F.max_by("act", "seq").alias("act"))


def one_hot(sched: DataFrame, duration: int = 1440, step: int = 15, acts: list[str] | None = None) -> DataFrame:
    """(pid, classes): per person a row of 0 and 1 for each sampled time, with a place per activity.

    acts: the activities, each of which has the place it has in the list; by default all, in order. Times without an
    episode count as the first activity. The vocabulary of activities is one row.
    """
    names = sorted(r[0] for r in sched.select("act").distinct().collect() if r[0] is not None) if acts is None else list(acts)
    bins, places = duration // step, F.array(*[F.lit(a) for a in names])
    place = F.greatest(F.array_position(places, F.col("act")) - 1, F.lit(0)).cast("int")
    found = discretised(sched, duration, step).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("bin", place.alias("place")))).alias("own"))
    persons = sched.select("pid").distinct().join(found, "pid", "left")
    here = lambda b: F.coalesce(F.try_element_at("own", b), F.lit(0))
    row = lambda b: F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda c: F.when(c == here(b), 1).otherwise(0))
    return persons.select("pid", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), row).alias("classes"))


def down_sampled(values: DataFrame, step: int, column: str = "classes") -> DataFrame:
    """values with every step-th entry of an array column, from the first on."""
    return values.withColumn(column, F.filter(column, lambda _, i: i % step == 0))


def binned_counts(sched: DataFrame, duration: int = 1440, step: int = 15) -> DataFrame:
    """(bin, act, count, density): persons per sampled time and activity, all combinations.

    Times without an episode count as the activity that the first row has.
    """
    acts = sched.agg(F.array_sort(F.collect_set("act")).alias("acts"), F.min_by("act", F.struct("pid", "seq")).alias("first"), F.count_distinct("pid").alias("n"))
    bins = duration // step
    grid = acts.select(F.explode("acts").alias("act"), "first", "n").select("act", "first", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    found = discretised(sched, duration, step).groupBy("bin", "act").agg(F.count("*").alias("found"))
    joined = grid.join(found, ["bin", "act"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    covered = F.sum("found").over(Window.partitionBy("bin"))
    count = F.col("found") + F.when(F.col("act") == F.col("first"), F.col("n") - covered).otherwise(0)
    return joined.select("bin", "act", count.alias("count"), (count / F.col("n")).alias("density"))


def activity_frequencies(sched: DataFrame, duration: int = 1440, step: int = 15, density: bool = False) -> DataFrame:
    """(segment, value, weight): an activity's persons (or their share) at each share of the day."""
    counts = binned_counts(sched, duration, step)
    return counts.select(F.col("act").alias("segment"), (F.col("bin") * (step / duration)).alias("value"), F.col("density" if density else "count").alias("weight"))


def time_use(sched: DataFrame, step: int = 1) -> DataFrame:
    """(minute, act, share): share of persons who do an activity at a time, start <= t < end."""
    n = sched.agg(F.count_distinct("pid").alias("n")).withColumn("one", F.lit(1))
    first, upto = F.ceil(F.col("start") / step).cast("int"), (F.ceil(F.col("end") / step) - 1).cast("int")
    stays = sched.withColumns({"first": first, "upto": upto}).where("first <= upto").select("pid", "act", "first", "upto")
    # A person counts once: overlapping and adjoining stays are joined, and only their ends are counted.
    before = Window.partitionBy("pid", "act").orderBy("first", "upto").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("first") > F.max("upto").over(before) + 1, F.lit(True)).cast("int")
    island = F.sum("begins").over(Window.partitionBy("pid", "act").orderBy("first", "upto").rowsBetween(Window.unboundedPreceding, 0))
    joined = stays.withColumn("begins", begins).withColumn("island", island).groupBy("pid", "act", "island").agg(F.min("first").alias("first"), F.max("upto").alias("upto"))
    ends = F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("change")), F.struct((F.col("upto") + 1).alias("at"), F.lit(-1).alias("change")))
    changes = joined.select("act", F.explode(ends).alias("e")).groupBy("act", F.col("e.at").alias("at")).agg(F.sum("e.change").alias("change"))
    by_time = Window.partitionBy("act").orderBy("at")
    counts = changes.withColumns({"persons": F.sum("change").over(by_time), "next": F.lead("at").over(by_time)}).where("persons > 0")
    spread = counts.select("act", "persons", F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("at")).withColumn("one", F.lit(1))
    return spread.join(F.broadcast(n), "one").select((F.col("at") * step).alias("minute"), "act", (F.col("persons") / F.col("n")).alias("share"))


def sequence_shares(sched: DataFrame) -> DataFrame:
    """(sequence, persons, share, upto): whole sequences by how many persons have them; upto: share of it and all rarer ones."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "act")))
    own = sched.groupBy("pid").agg(F.array_join(F.transform(steps, lambda s: s["act"]), ">").alias("sequence"))
    counts = stored(own.groupBy("sequence").agg(F.count("*").alias("persons")), "sequences")
    different, total = counts.agg(F.count("*"), F.sum("persons")).first()
    before = running(counts, [F.col("persons").desc(), F.col("sequence").asc()], {"before": F.col("persons")}, different)
    n = F.lit(total or 1)
    return before.select("sequence", "persons", (F.col("persons") / n).alias("share"), ((n - F.col("before")) / n).alias("upto"))


def bigram_matrix(sched: DataFrame) -> DataFrame:
    """(act, after, rate): transitions per person."""
    after = F.lead("act").over(Window.partitionBy("pid").orderBy("seq"))
    n = sched.agg(F.count_distinct("pid").alias("n")).withColumn("one", F.lit(1))
    counts = sched.select("act", after.alias("after")).where("after is not null").groupBy("act", "after").agg(F.count("*").alias("c")).withColumn("one", F.lit(1))
    return counts.join(F.broadcast(n), "one").select("act", "after", (F.col("c") / F.col("n")).alias("rate"))


def participation_table(sched: DataFrame) -> DataFrame:
    """(act, rate, share): mean occurrences per person, and share of persons with any."""
    n = sched.agg(F.count_distinct("pid").alias("n")).withColumn("one", F.lit(1))
    counts = sched.groupBy("act").agg(F.count("*").alias("c"), F.count_distinct("pid").alias("p")).withColumn("one", F.lit(1))
    return counts.join(F.broadcast(n), "one").select("act", (F.col("c") / F.col("n")).alias("rate"), (F.col("p") / F.col("n")).alias("share"))


def length_table(sched: DataFrame) -> DataFrame:
    """(length, persons)."""
    return sched.groupBy("pid").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("persons"))


def time_histogram(sched: DataFrame, column: str = "start", width: float = 30.0) -> DataFrame:
    """(act, bin, episodes): an activity's times in bins that begin at multiples of width."""
    return sched.groupBy("act", (F.floor(F.col(column) / width) * width).alias("bin")).agg(F.count("*").alias("episodes"))


def joint_histogram(sched: DataFrame, width: float = 30.0) -> DataFrame:
    """(act, start_bin, duration_bin, episodes)."""
    at = lambda c: F.floor(F.col(c) / width) * width
    return sched.groupBy("act", at("start").alias("start_bin"), at("duration").alias("duration_bin")).agg(F.count("*").alias("episodes"))


def gantt_table(sched: DataFrame, persons: int = 8) -> DataFrame:
    """Episodes of the first persons."""
    some = sched.select("pid").distinct().orderBy("pid").limit(persons)
    return sched.join(F.broadcast(some), "pid").select("pid", "act", "start", "end", "duration", "seq")


def first_starts(sched: DataFrame, act: str) -> DataFrame:
    """(pid, first, total): first start and total duration of an activity."""
    return sched.where(F.col("act") == act).groupBy("pid").agg(F.min("start").alias("first"), F.sum("duration").alias("total"))
