"""Which features are evaluated, and how each is described and scored."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Feature:
    """One feature: rows of it are (segment, value) pairs of persons.

    zeros: persons without a segment count with value 0 ("all", or those with at least that many episodes), or None
    if they don't count. describe: mean (0 if empty), time (null if empty) or plane (sum of both components).
    missing: distance where one side lacks the segment; None compares with a point at 0.
    fn: custom features only, canonical table with model -> (model, pid, segment, acts, v1, v2).
    size, describe_by, distance: replace how a feature's segments are weighed, described and scored; each is given rows of
    the feature's histograms with the columns of a cell (model, label, cat, fid, segment), v1 and v2, and returns a value
    per cell. size and describe_by: counts w -> weight, or value. distance: observed and model counts wa and wb -> value.
    """

    domain: str
    name: str
    section: str
    key: str
    unit: str
    text: str
    default: bool
    zeros: int | str | None = None
    describe: str = "mean"
    missing: float | None = None
    dims: int = 1
    fn: Callable[[DataFrame], DataFrame] | None = None
    size: Callable[[DataFrame], DataFrame] | None = None
    describe_by: Callable[[DataFrame], DataFrame] | None = None
    distance: Callable[[DataFrame], DataFrame] | None = None


def _counts(name: str, key: str, text: str, default: bool, unit: str = "av. rate") -> Feature:
    return Feature("participations", name, "participations", key, unit, text, default, "all")


def _grams(n: int) -> Feature:
    return Feature("transitions", f"{n}-gram", "transitions", f"{n}-gram", "av. rate", f"How often each person makes each sequence of {n} activities.", True, n)


def _times(name: str, key: str, text: str, default: bool, dims: int = 1) -> Feature:
    return Feature("timing", name, "timing", key, "average", text, default, None, "plane" if dims == 2 else "time", 1.0, dims)


# Domains, names, config keys and units of the features.
FEATURES: tuple[Feature, ...] = (
    _counts("lengths", "lengths", "Number of episodes of each person.", True, "length."),
    _counts("participation rate", "rates", "How often each person does each activity.", True),
    _counts("pair participation rate", "pair_rates", "How often each person does both activities of a pair.", True, "av rate."),
    _counts("seq participation rate", "seq_rates", "Whether each person does an activity at a position.", False),
    _counts("enum participation rate", "enum_rates", "Whether each person does an activity for the n-th time.", False),
    _grams(2),
    _grams(3),
    _grams(4),
    _times("start times", "start_times", "Start of each activity's n-th occurrence.", True),
    _times("durations", "durations", "Duration of each activity's n-th occurrence.", True),
    _times("start-durations", "start_durations", "Start and duration of each activity, binned.", True, 2),
    _times("joint-durations", "joint_durations", "Durations of an episode and the next, binned, by the first one's activity.", True, 2),
    _times("start times by act", "start_times_by_act", "Start of each activity, binned.", False),
    _times("end times by act", "end_times_by_act", "End of each activity, binned.", False),
    _times("durations by act", "durations_by_act", "Duration of each activity, binned.", False),
    replace(_times("time consistency", "time_consistency", "Whether schedules start at 0, end with the day and fill it.", False), zeros="all", describe="mean", missing=None, unit="prob."),
    Feature("sequences", "full sequences", "sequences", "full_sequences", "av. rate", "Whether each person has a sequence of activity initials.", False, "all"),
)

# Rows that higher tiers leave out.
DROP_FEATURES = (
    ("feasibility", "not home based", "starts"),
    ("feasibility", "not home based", "ends"),
    ("feasibility", "consecutive", "home"),
    ("feasibility", "consecutive", "work"),
    ("feasibility", "consecutive", "education"),
)
DROP_GROUPS = (("feasibility", "not home based"), ("feasibility", "consecutive"))


@dataclass(frozen=True)
class Jobs:
    """What is evaluated. day: length of a day; bin: width of time bins."""

    features: tuple[Feature, ...] = tuple(f for f in FEATURES if f.default)
    min_count: int = 3
    min_count_trigger: int = 10
    diversity: bool = True
    novelty: bool = True
    home_based: bool = True
    home_based_novel: bool = False
    consecutive: bool = True
    consecutive_novel: bool = False
    day: float = 1440.0
    bin: float = 15.0
    extra: tuple[Feature, ...] = field(default=())

    @property
    def all_features(self) -> tuple[Feature, ...]:
        return self.features + self.extra

    @property
    def creativity(self) -> bool:
        return self.diversity or self.novelty

    @property
    def needs_novel(self) -> bool:
        return self.home_based_novel or self.consecutive_novel


def jobs_from_config(config: dict) -> Jobs:
    """Jobs of a parsed config; what it doesn't mention is on, except the novel-only structural checks."""
    jobs, grams = config.get("jobs", {}), config.get("ngrams", {})
    c, s = jobs.get("creativity", {}), jobs.get("structural", {})
    return Jobs(
        tuple(f for f in FEATURES if jobs.get(f.section, {}).get(f.key, True)),
        grams.get("min_count", 3), grams.get("min_count_trigger", 10),
        c.get("diversity", True), c.get("novelty", True),
        s.get("home_based", True), s.get("home_based_novel", False), s.get("consecutive", True), s.get("consecutive_novel", False),
    )


def get_jobs(path: str | Path | None = None) -> Jobs:
    """Jobs of a TOML file, or the defaults."""
    if path is None:
        return Jobs()
    with open(path, "rb") as f:
        return jobs_from_config(tomllib.load(f))


def catalogue() -> list[tuple[str, str, str, str, bool]]:
    """(domain, name, config key, description, on by default) of every feature."""
    return [(f.domain, f.name, f.key, f.text, f.default) for f in FEATURES]
