"""Registered queries against their SQL, on the smallest tables."""

import itertools

import numpy as np
import pytest

from daymosaic.plans.queries import QUERIES
from daymosaic.plans.sql import SQL

from .conftest import same_rows

#: One of each kind; the rest differ in a feature's name only.
SOME = ["schedule_view", "pair_participation_hist", "ngram_min_count", "joint_duration_hist2d", "time_consistency", "emd1d_start", "emd1d_ngram4", "feasibility_novel", "creativity_distances", "filter_novel", "split_numeric_bins", "split_by_category", "domains_tier_novel", "rank_groups", "activity_density", "time_use", "sequence_probs", "feature_catalogue", "sliced_wasserstein", "scalar_distances", "pairwise_default", "pairwise_chamfer"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf, duck, name):
    assert same_rows(QUERIES[name](spark, sf), duck, SQL[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_plane_distances_lie_between_means_and_an_assignment(spark, sf):
    """Exact distances of a query: at least the city-block distance of the means, at most what any assignment costs, and
    equal to the least of all assignments where there are few points."""
    from daymosaic.functions.transport import emd_points

    hist = QUERIES["start_duration_hist2d"](spark, sf).toPandas()
    found = {(r["model"], r["segment"]): r["emd"] for r in QUERIES["emd2d_start_durations"](spark, sf).collect()}
    assert found
    x, y, w = [c for c in hist.columns if c not in ("model", "segment")][:3]
    tried = 0
    for (model, segment), emd in found.items():
        sides = [hist[(hist["model"] == m) & (hist["segment"] == segment)] for m in ("observed", model)]
        if any(s.empty for s in sides):
            continue
        means = [(s[[x, y]].to_numpy(float) * s[[w]].to_numpy(float)).sum(0) / s[w].sum() for s in sides]
        a, b = (s.sort_values([x, y])[[x, y, w]].to_numpy(float) for s in sides)
        cost, i, j, left, right = 0.0, 0, 0, a[0, 2] / a[:, 2].sum(), b[0, 2] / b[:, 2].sum()
        while i < len(a) and j < len(b):  # mass goes over in the order of the points
            moved = min(left, right)
            cost += moved * abs(a[i, :2] - b[j, :2]).sum()
            left, right = left - moved, right - moved
            if left < 1e-12:
                i += 1
                left = a[i, 2] / a[:, 2].sum() if i < len(a) else 0
            if right < 1e-12:
                j += 1
                right = b[j, 2] / b[:, 2].sum() if j < len(b) else 0
        assert abs(means[0] - means[1]).sum() - 1e-6 <= emd <= cost + 1e-6
        tried += 1
    assert tried > 2
    rng = np.random.default_rng(0)
    for _ in range(20):
        p, q = rng.integers(0, 6, (5, 2)), rng.integers(0, 6, (5, 2))
        least = min(sum(abs(p[i] - q[j]).sum() for i, j in enumerate(order)) for order in itertools.permutations(range(5))) / 5
        assert emd_points(p, np.ones(5, int), q, np.ones(5, int)) == pytest.approx(least)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    out = e.entry(spark)
    assert out.columns == ["domain", "model_a", "model_b"] and out.count() == 5
