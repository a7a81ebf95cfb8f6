"""Synthetic populations from weighted day profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLOOR = 0.3
DAY = 1440
# Each profile's times as (name, mean, deviation, low, high, least gap after the time before), and its
# episodes as (activity, start, end). Three fields (name, other, minutes) put a time a while after another.
PROFILES: dict[str, tuple[list[tuple], list[tuple]]] = {
    "office": ([("work", 450, 30, 390, 510, 0), ("lunch", 810, 15, 750, 870, 60), ("back", "lunch", 60), ("off", 1080, 20, 1020, 1140, 60)], [("home", 0, "work"), ("work", "work", "lunch"), ("eat_out", "lunch", "back"), ("work", "back", "off"), ("home", "off", DAY)]),
    "flexible": ([("work", 480, 45, 360, 600, 0), ("off", 960, 30, 900, 1080, 60), ("shop", "off", 60)], [("home", 0, "work"), ("work", "work", "off"), ("shop", "off", "shop"), ("home", "shop", DAY)]),
    "student": ([("in", 540, 30, 480, 600, 0), ("out", 840, 20, 780, 900, 60), ("late", "out", 120)], [("home", 0, "in"), ("education", "in", "out"), ("leisure", "out", "late"), ("home", "late", DAY)]),
    "part_time": ([("work", 540, 30, 480, 600, 0), ("off", 900, 30, 840, 960, 60)], [("home", 0, "work"), ("work", "work", "off"), ("home", "off", DAY)]),
    "leisure_shopper": ([("go", 420, 60, 300, 540, 0), ("on", 780, 60, 600, 900, 120), ("shop", "on", 90)], [("home", 0, "go"), ("leisure", "go", "on"), ("shop", "on", "shop"), ("home", "shop", DAY)]),
    "late_worker": ([("work", 600, 90, 360, 900, 0), ("off", 1080, 60, 960, 1380, 120)], [("home", 0, "work"), ("work", "work", "off"), ("home", "off", DAY)]),
    "home_heavy": ([("go", 600, 60, 480, 720, 0), ("back", 1200, 60, 1080, 1380, 120)], [("home", 0, "go"), ("leisure", "go", "back"), ("home", "back", DAY)]),
}


class PopulationGenerator:
    """Schedules whose profiles are drawn by weight; every profile has at least the floor's weight."""

    def __init__(self, profile_weights: dict[str, float] | None = None, seed: int = 42) -> None:
        if unknown := set(profile_weights or {}) - set(PROFILES):
            raise ValueError(f"unknown profiles {sorted(unknown)}")
        weights = {p: max((profile_weights or {}).get(p, 0.0), FLOOR) for p in PROFILES}
        total = sum(weights.values())
        self.shares, self.seed = {p: w / total for p, w in weights.items()}, seed

    def __call__(self, spark: SparkSession, n: int = 500) -> DataFrame:
        return self.generate(spark, n)

    def generate(self, spark: SparkSession, n: int = 500) -> DataFrame:
        """(pid, act, start, end, duration) of n persons; minutes of a day. The same seed gives the same schedules."""
        df = spark.range(n).select(F.col("id").alias("pid"), F.rand(self.seed).alias("u"), *[F.randn(self.seed + 1 + i).alias(f"z{i}") for i in range(3)])
        made = None
        for name, (times, plan) in reversed(list(PROFILES.items())):
            upto = sum(w for p, w in list(self.shares.items())[: list(PROFILES).index(name) + 1])
            entries = self._episodes(times, plan)
            made = entries if made is None else F.when(F.col("u") < upto, entries).otherwise(made)
        rows = df.select("pid", F.posexplode(made).alias("place", "e"))
        return rows.select("pid", "e.act", "e.start", "e.end", (F.col("e.end") - F.col("e.start")).alias("duration"))

    @staticmethod
    def _episodes(times: list[tuple], plan: list[tuple]) -> Column:
        at: dict[str, Column] = {}
        last, drawn = F.lit(0.0), 0
        for t in times:
            if len(t) == 3:
                at[t[0]] = F.least(at[t[1]] + t[2], F.lit(float(DAY)))
            else:
                name, mean, deviation, low, high, gap = t
                least = F.greatest(last + gap, F.lit(float(low))) if gap else F.lit(float(low))
                at[name] = F.round(F.least(F.greatest(F.col(f"z{drawn}") * deviation + mean, least), F.greatest(F.lit(float(high)), least)))
                drawn += 1
            last = at[t[0]]
        col = lambda x: at[x] if isinstance(x, str) else F.lit(float(x))
        return F.array(*[F.struct(F.lit(a).alias("act"), col(s).alias("start"), col(e).alias("end")) for a, s, e in plan])
