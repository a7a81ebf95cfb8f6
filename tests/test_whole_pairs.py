"""Queries over all schedules against loops, on a small event log."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from daymosaic.functions import sinkhorn
from daymosaic.plans.queries import QUERIES
from daymosaic.sources import events

KINDS = ["view", "click", "purchase", "signup", "other"]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng, rows = np.random.default_rng(3), []
    for user in range(6):
        for day in (3, 16, 17):
            for _ in range(14 if user == 0 else int(rng.integers(1, 5))):  # user 0 has more episodes than 12
                rows.append((user, len(rows), datetime(2024, 1, day) + timedelta(minutes=int(rng.integers(1440))), KINDS[int(rng.integers(5))]))
    path = str(tmp_path_factory.mktemp("log"))
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string").write.parquet(f"{path}/events.parquet")
    return path


def schedules(spark, log):
    out = {}
    for r in sorted(events.schedules(spark, log).collect(), key=lambda r: (r["pid"], r["seq"])):
        out.setdefault(r["pid"], []).append((r["act"], r["duration"], r["start"]))
    return out


def test_every_pair_of_schedules(spark, log):
    own = schedules(spark, log)
    acts = sorted({a for x in own.values() for a, _, _ in x})
    counts = np.array([[sum(a == b for a, _, _ in own[p]) for b in acts] for p in sorted(own)], float)
    low, high = counts.min(0), counts.max(0)
    scaled = (counts - low) / np.where(high > low, high - low, 1)
    got = {(r["pid_a"], r["pid_b"]): r["distance"] for r in QUERIES["pairwise_schedules_participation_mae"](spark, log).collect()}
    pids = sorted(own)
    assert len(pids) == 18 and len(got) == 18 * 17 // 2
    for i, p in enumerate(pids):
        for j, q in enumerate(pids[:i]):
            assert got[q, p] == pytest.approx(np.abs(scaled[i] - scaled[j]).mean(), abs=1e-8)


def test_sequences_are_whole(spark, log):
    own = schedules(spark, log)
    acts = sorted({a for x in own.values() for a, _, _ in x})
    longest = max(map(len, own.values()))
    assert longest > 12
    points = {p: np.array([(acts.index(a) / len(acts), d / 1440) for a, d, _ in x] + [(1.0, 0.0)] * (longest - len(x))) for p, x in own.items()}
    got = QUERIES["pairwise_schedules_chamfer"](spark, log).collect()
    assert len(got) == 18 * 17 // 2
    for r in got:
        d = np.sqrt(((points[r["pid_a"]][:, None] - points[r["pid_b"]][None]) ** 2).sum(2))
        assert r["distance"] == pytest.approx((d.min(1).mean() + d.min(0).mean()) / 2 / np.sqrt(2), abs=1e-8)


def test_sinkhorn_takes_all_episodes(spark, log):
    points = {}
    for r in events.schedules(spark, log).collect():
        points.setdefault((r["model"], r["act"]), []).append((r["start"] / 1440, r["duration"] / 1440))
    got = QUERIES["sinkhorn"](spark, log).collect()
    assert got
    for r in got:
        want = sinkhorn.transport_plan(points["observed", r["act"]], points[r["model"], r["act"]])[0]
        assert r["distance"] == pytest.approx(want, rel=1e-6)


def test_cost_in_parts_is_the_plans():
    rng = np.random.default_rng(0)
    x, y = rng.random((37, 2)), rng.random((23, 2))
    assert sinkhorn.transport_cost(x, y, cells=50) == pytest.approx(sinkhorn.transport_plan(x, y)[0])


@pytest.mark.parametrize("shape", [(90, 60, 2, 30), (40, 50, 1, 1440), (80, 70, 3, 3), (9, 11, 2, 10**6)])
def test_cost_along_axes_is_the_plans(shape):
    n, m, dims, at = shape
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, at, (n, dims)) / at, rng.integers(0, at, (m, dims)) / at
    for rounds in (1, 10, 100):
        want = sinkhorn.transport_plan(x, y, max_iter=rounds)[0]
        assert sinkhorn.transport_cost(x, y, max_iter=rounds) == pytest.approx(want)
        assert sinkhorn.transport_cost(x, y, max_iter=rounds, cells=9) == pytest.approx(want)


def test_a_day_of_points_does_not_grow_with_episodes():
    rng = np.random.default_rng(0)
    points = lambda n: rng.integers(0, 96, (n, 2)) / 96
    began = time.perf_counter()
    value = sinkhorn.transport_cost(points(200_000), points(150_000))  # 30 billion pairs
    assert 0 < value < 0.2 and time.perf_counter() - began < 20


def test_an_activity_of_one_side_only(spark):
    rows = [("p", "a", [0.0, 0.0]), ("p", "b", [0.5, 0.0]), ("q", "a", [0.0, 0.0])]
    got = {r["k"]: r["distance"] for r in sinkhorn.sinkhorn(spark.createDataFrame(rows, "k string, side string, x array<double>"), ["k"]).collect()}
    assert got["p"] == pytest.approx(0.5) and got["q"] is None
