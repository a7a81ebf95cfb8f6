"""Transport, scalar distances and pairs."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daymosaic.functions import scalar, sinkhorn
from daymosaic.functions.transport import emd_line, emd_points
from daymosaic.operators import pairwise
from daymosaic.operators.emd import line_distances

cell = st.tuples(st.integers(0, 5), st.integers(0, 5))


@settings(max_examples=60, deadline=None)
@given(st.lists(cell, min_size=5, max_size=5), st.lists(cell, min_size=5, max_size=5))
def test_plane_equals_best_permutation(a, b):
    cost = lambda p: sum(abs(x - u) + abs(y - v) for (x, y), (u, v) in zip(a, p, strict=True))
    best = min(cost(p) for p in itertools.permutations(b)) / 5
    ones = np.ones(5, int)
    assert emd_points(np.array(a), ones, np.array(b), ones) == pytest.approx(best)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), min_size=1, max_size=12))
def test_plane_on_a_line_equals_the_closed_form(a, b):
    (x, u), (y, v) = (tuple(map(np.array, zip(*s, strict=True))) for s in (a, b))
    flat = lambda z: np.stack([z, np.zeros_like(z)], 1)
    assert emd_points(flat(x), u, flat(y), v) == pytest.approx(emd_line(x, u, y, v))


def test_large_histograms():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, (900, 2)), rng.integers(0, 60, (700, 2))
    u, v = rng.integers(1, 9, 900), rng.integers(1, 9, 700)
    value = emd_points(a, u, b, v)
    assert abs(np.average(a[:, 0], weights=u) - np.average(b[:, 0], weights=v)) <= value < 10
    assert emd_points(b, v, a, u) == pytest.approx(value)


def test_line_distances_in_a_plan(spark):
    rows = spark.createDataFrame([("x", 0.0, 1, 0), ("x", 3.0, 0, 1), ("y", 2.0, 1, 1), ("z", 4.0, 2, 0)], "k string, v1 double, wa long, wb long")
    assert {r["k"]: r["value"] for r in line_distances(rows, ["k"]).collect()} == {"x": 3.0, "y": 0.0, "z": 4.0}


def test_scalars(spark):
    rows = spark.createDataFrame([("p", 0.0, 1, 0), ("p", 1.0, 0, 1), ("q", 10.0, 1, 0), ("q", 8.0, 0, 1), ("q", 10.0, 0, 1)], "k string, v double, wa long, wb long")
    weights = {r["k"]: (r["mae"], r["mse"]) for r in scalar.weight_distances(rows, ["k"]).collect()}
    assert weights["p"] == (1.0, 1.0)
    means = {r["k"]: (r["abs_av_diff"], r["mape"]) for r in scalar.mean_distances(rows, ["k"]).collect()}
    assert means["q"] == pytest.approx((1.0, 1 / 9)) and means["p"] == (1.0, 1.0)
    assert scalar.mape_scalar([1, 2], [1, 1]) == 0.25
    same = spark.createDataFrame([("p", 1.0)], "s string, v double")
    assert scalar.same_histograms(same, same) and not scalar.same_histograms(same, same.limit(0))


def test_sliced_and_entropic(spark):
    rows = [("g", "a", [0.0, 0.0]), ("g", "a", [1.0, 0.0]), ("g", "b", [0.0, 1.0]), ("g", "b", [1.0, 1.0])]
    points = spark.createDataFrame(rows, "k string, side string, x array<double>")
    assert 0.4 < scalar.sliced_wasserstein(points, 200) < 0.8
    assert sinkhorn.sinkhorn(points, ["k"], max_iter=100).first()["distance"] == pytest.approx(1.0, abs=1e-3)
    cost, plan, _ = sinkhorn.transport_plan(np.zeros((3, 1)), np.zeros((3, 1)))
    assert cost == 0 and plan.sum() == pytest.approx(1, abs=1e-4)


def test_sides_share_a_sort(spark):
    rng = np.random.default_rng(0)
    sides = {s: rng.integers(0, 4, (n, 2)) / 4 for s, n in (("o", 40), ("m", 25), ("n", 30))}
    rows = [(s, [float(v) for v in x]) for s, points in sides.items() for x in points]
    points = spark.createDataFrame(rows, "side string, x array<double>")
    got = scalar.sliced_distances(points, "o", ["m", "n", "absent"], 12)
    for m in ("m", "n"):
        lines = [(sides["o"] @ d, sides[m] @ d) for d in scalar.random_directions(2, 12)]
        want = np.mean([emd_line(a, np.ones(len(a)), b, np.ones(len(b))) for a, b in lines])
        assert got[m] == pytest.approx(want)
    assert got["absent"] is None


def test_equal_points_are_spread_over_directions_once(spark):
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 'a', 'b') as side", "array(cast(id % 5 as double), cast(id % 3 as double)) as x")
    handed, repartition = [], type(rows).repartition
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows), "repartition", lambda df, *a: handed.append(df.count()) or repartition(df, *a))
        scalar.sliced_wasserstein(rows, 8)
    assert handed[-1] == 15 * 8  # 20,000 * 8 before


THREE = pd.DataFrame([(0, "home", 0, 24), (1, "home", 0, 8), (1, "work", 8, 16), (1, "home", 16, 24), (2, "home", 0, 6), (2, "work", 6, 14), (2, "shop", 14, 18), (2, "home", 18, 24)], columns=["pid", "act", "start", "end"])


def test_pairs_are_complete_whatever_the_blocks(spark):
    whole = pairwise.pairwise_distances(THREE).matrix
    assert np.allclose(whole, whole.T) and (np.diag(whole) == 0).all() and (whole >= 0).all() and (whole <= 1).all()
    assert np.allclose(pairwise.pairwise_distances(THREE, block=1, chunk_size=1).matrix, whole)
    counts = np.array([[1, 0, 0], [2, 1, 0], [2, 1, 1]], float)
    spread = (counts - counts.min(0)) / (counts.max(0) - counts.min(0))
    want = np.abs(spread[:, None] - spread[None]).mean(2)
    assert np.allclose(pairwise.pairwise_distances(THREE, pairwise.default_specs()[:1]).matrix, want)


def test_sequence_distances(spark):
    specs = [pairwise.chamfer_spec(weight=2.0), pairwise.soft_dtw_spec(max_len=4, gamma=0.1)]
    both = pairwise.pairwise_distances(THREE, specs).matrix
    parts = [pairwise.pairwise_distances(THREE, [s]).matrix for s in specs]
    assert np.allclose(both, (2 * parts[0] + parts[1]) / 3, equal_nan=True)
    x = np.array([[[0.0, 0.0], [1.0, 0.0]]])
    assert pairwise.soft_dtw_values(x, x, 1e-3)[0] == pytest.approx(0, abs=1e-2)


def test_one_schedule_is_too_few(spark):
    with pytest.raises(ValueError, match="at least 2"):
        pairwise.pairwise_distances(THREE[THREE.pid == 0])
