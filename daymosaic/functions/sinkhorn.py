"""Entropy-regularised transport between two equally weighted point sets, in the log domain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is added to masses inside logarithms; mean change of the duals at which iteration stops.
TINY, STOP = 1e-8, 0.1
#: Cells of a plan that a task holds.
CELLS = 2_000_000


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def transport_plan(x: np.ndarray, y: np.ndarray, eps: float = 0.01, max_iter: int = 10, p: float = 1) -> tuple[float, np.ndarray, np.ndarray]:
    """(cost, plan, cost matrix) with costs |x - y|**p summed over coordinates."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    cost = (np.abs(x[:, None, :] - y[None, :, :]) ** p).sum(2)
    u, v = np.zeros(len(x)), np.zeros(len(y))
    kernel = lambda: (u[:, None] + v[None, :] - cost) / eps
    for _ in range(max_iter):
        before = u
        u = eps * (np.log(1 / len(x) + TINY) - _logsumexp(kernel(), 1)) + u
        v = eps * (np.log(1 / len(y) + TINY) - _logsumexp(kernel(), 0)) + v
        if np.abs(u - before).sum() < STOP:
            break
    plan = np.exp(kernel())
    return float((plan * cost).sum()), plan, cost


def _along(v: np.ndarray, at: np.ndarray, eps: float, axis: int, weigh: bool = False) -> np.ndarray:
    """log of the sum over an axis of exp(v - d / eps), times d if weigh; d: distance of coordinates, which are sorted.

    Two scans do it: a step further along the axis, all distances behind it grow alike.
    """
    v = np.ascontiguousarray(np.moveaxis(v, axis, 0))
    steps = np.diff(at)
    out = np.full_like(v, -np.inf) if weigh else v.copy()
    for places, to in ((range(len(at) - 1), 1), (range(len(at) - 1, 0, -1), -1)):
        behind = far = np.full_like(v[0], -np.inf)  # sums over what lies behind: plain and times the distance
        for k in places:
            step = float(steps[k if to > 0 else k - 1])
            behind = np.logaddexp(behind, v[k])
            if weigh:
                far = np.logaddexp(far, behind + np.log(step)) - step / eps
            behind = behind - step / eps
            out[k + to] = np.logaddexp(out[k + to], far if weigh else behind)
    return np.moveaxis(out, 0, axis)


class _Grid:
    """Sums over all pairs of points with city-block costs, by scans along the axes of the grid of all coordinates."""

    def __init__(self, x: np.ndarray, y: np.ndarray, eps: float) -> None:
        self.eps, self.axes = eps, [np.unique(np.concatenate([x[:, k], y[:, k]])) for k in range(x.shape[1])]
        self.cells = int(np.prod([len(a) for a in self.axes], dtype=float))
        self.of = lambda z: tuple(np.searchsorted(a, z[:, k]) for k, a in enumerate(self.axes))

    def sums(self, to: np.ndarray, of: np.ndarray, logs: np.ndarray, weigh: int | None = None) -> np.ndarray:
        """For each point of `to`, log of the sum over `of` of exp(logs - cost / eps), times the cost along one axis."""
        grid = np.full([len(a) for a in self.axes], -np.inf)
        grid[self.of(of)] = logs
        for k, at in enumerate(self.axes):
            grid = _along(grid, at, self.eps, k, k == weigh)
        return grid[self.of(to)]


def _distinct(x: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, float)
    points, place = np.unique(x, axis=0, return_inverse=True)
    return points, np.bincount(place.ravel(), np.ones(len(x)) if weights is None else weights, len(points))


def transport_cost(x: np.ndarray, y: np.ndarray, eps: float = 0.01, max_iter: int = 10, p: float = 1, cells: int = CELLS, wx: np.ndarray | None = None, wy: np.ndarray | None = None) -> float:
    """The cost of transport_plan, whose plan is never held. wx, wy: how often each point occurs.

    Equal points have equal duals, so each is looked at once. City-block costs of points on a grid that is smaller than
    the plan are summed along its axes; otherwise some `cells` of the plan are in memory at a time.
    """
    (x, wx), (y, wy) = _distinct(x, wx), _distinct(y, wy)
    n, m, many_x, many_y = wx.sum(), wy.sum(), np.log(wx), np.log(wy)
    u, v, step = np.zeros(len(x)), np.zeros(len(y)), max(1, cells // max(1, len(y)))
    grid = _Grid(x, y, eps) if p == 1 else None
    if grid is not None and grid.cells > min(10 * cells, len(x) * len(y)):
        grid = None
    parts = [slice(at, at + step) for at in range(0, len(x), step)]
    costs = lambda s: sum(np.abs(x[s, None, k] - y[None, :, k]) ** p for k in range(x.shape[1]))
    for _ in range(max_iter):
        before = u
        if grid is not None:
            u = eps * (np.log(1 / n + TINY) - grid.sums(x, y, v / eps + many_y))
            down = grid.sums(y, x, u / eps + many_x)
        else:
            u, down = u.copy(), np.full(len(y), -np.inf)
            for s in parts:  # rows are whole in a part, columns add up over the parts
                cost = costs(s)
                u[s] = eps * (np.log(1 / n + TINY) - _logsumexp((v[None, :] - cost) / eps + many_y[None, :], 1))
                down = np.logaddexp(down, _logsumexp((u[s, None] - cost) / eps + many_x[s, None], 0))
        v = eps * (np.log(1 / m + TINY) - down)
        if (np.abs(u - before) * wx).sum() < STOP:
            break
    if grid is not None:
        found = sum(np.exp(u / eps + many_x + grid.sums(x, y, v / eps + many_y, k)) for k in range(x.shape[1]))
        return float(np.sum(found))
    mass = lambda s: (u[s, None] + v[None, :]) / eps + many_x[s, None] + many_y[None, :]
    return float(sum((np.exp(mass(s) - cost / eps) * cost).sum() for s in parts for cost in [costs(s)]))


def sinkhorn(points: DataFrame, keys: list[str], eps: float = 0.01, max_iter: int = 10) -> DataFrame:
    """(keys, distance) of each group of (keys, side 'a' or 'b', x array<double>); null where a side is missing.

    A task gets the distinct points of a group and how often each occurs.
    """

    def solve(group: pa.Table) -> pa.Table:
        sides = []
        for s in "ab":
            own = group.filter(pc.equal(group["side"], s))
            x = own["x"].combine_chunks()
            sides.append((x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else None, own["n"].to_numpy()))
        (a, wa), (b, wb) = sides
        value = None if a is None or b is None else transport_cost(a, b, eps, max_iter, wx=wa, wy=wb)
        return group.select(keys).slice(0, 1).append_column("distance", pa.array([value], pa.float64()))

    own = points.groupBy(*keys, "side", "x").agg(F.count("*").alias("n"))
    # Few rows but much work: a fixed number of partitions, which Spark doesn't merge for being small.
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    return own.repartition(tasks, *keys).groupBy(*keys).applyInArrow(solve, points.select(*keys).schema.add("distance", "double"))
