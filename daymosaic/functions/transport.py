"""Exact optimal transport between two weighted point sets with city-block costs."""

from __future__ import annotations

import numpy as np


def _net(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, list[int]]:
    """Points and integer masses that are left once equal points cancel. Masses are scaled to one common total."""
    total_a, total_b = int(wa.sum()), int(wb.sum())
    net: dict[tuple, int] = {}
    for points, weights, scale in ((a, wa, total_b), (b, wb, -total_a)):
        for p, w in zip(map(tuple, points.tolist()), weights.tolist(), strict=True):
            net[p] = net.get(p, 0) + int(w) * scale
    left, right = ([(p, abs(m)) for p, m in sorted(net.items()) if m * sign > 0] for sign in (1, -1))
    shape = a.shape[1]
    return (np.array([p for p, _ in left]).reshape(-1, shape), [m for _, m in left], np.array([p for p, _ in right]).reshape(-1, shape), [m for _, m in right])


def _prices(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray, halvings: int = 9, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Approximate prices of both sides: entropic transport, smoothed less and less, in the log domain."""
    f, g = np.zeros(len(supply)), np.zeros(len(demand))
    a, b = supply / supply.sum(), demand / demand.sum()
    eps = float(cost.max()) or 1.0
    for _ in range(halvings):
        eps /= 2
        kernel = np.exp(np.clip((f[:, None] + g[None, :] - cost) / eps, -500, 200))
        u, v = np.ones_like(f), np.ones_like(g)
        for _ in range(rounds):
            u = a / np.maximum(kernel @ v, 1e-250)
            v = b / np.maximum(u @ kernel, 1e-250)
        f, g = f + eps * np.log(u), g + eps * np.log(v)
    return f, g


def _start(cost: np.ndarray, supply: list[int], demand: list[int]) -> list[tuple[int, int, int]]:
    """A feasible tree: pairs are filled in the order of their cost at approximate prices."""
    f, g = _prices(cost, np.array(supply, float), np.array(demand, float))
    order = np.argsort((cost - f[:, None] - g[None, :]).astype(np.float32).ravel(), kind="stable")
    left, room, arcs = list(supply), list(demand), []
    open_left, open_room = np.ones(len(left), bool), np.ones(len(room), bool)
    at, step = 0, 4 * (len(left) + len(room))
    while at < len(order):
        i, j = np.divmod(order[at : at + step], len(room))
        keep = open_left[i] & open_room[j]
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            moved = min(left[x], room[y])
            if moved:
                arcs.append((x, y, moved))
                left[x] -= moved
                room[y] -= moved
                open_left[x], open_room[y] = left[x] > 0, room[y] > 0
        at += step
    return arcs


def transport_cost(cost: np.ndarray, supply: list[int], demand: list[int], block: int = 64) -> float:
    """Least cost of moving supply to demand (equal totals, positive integers): the network simplex method.

    Masses are perturbed so that every basis is non-degenerate, which rules out cycling; the optimal prices are then
    applied to the true masses.
    """
    n, m = cost.shape
    if not n or not m:
        return 0.0
    unit = n + m + 1
    mass = [s * unit + 1 for s in supply]
    want = [d * unit for d in demand]
    want[-1] += n
    size = n + m
    near: list[dict[int, int]] = [{} for _ in range(size)]  # tree neighbours and flow
    for i, j, flow in _start(cost, mass, want):
        near[i][n + j] = near[n + j][i] = flow
    parent, depth, price = [-1] * size, [0] * size, [0.0] * size
    of = cost.item  # a list of lists would take many times the matrix's memory

    def hang(root: int, above: int) -> None:
        """Set parents, depths and prices of what root leads to, away from above."""
        parent[root] = above
        stack = [root]
        while stack:
            v = stack.pop()
            p = parent[v]
            if p >= 0:
                depth[v] = depth[p] + 1
                price[v] = (of(v, p - n) if v < n else of(p, v - n)) - price[p]
            for w in near[v]:
                if w != p:
                    parent[w] = v
                    stack.append(w)

    def smaller(i: int, j: int) -> int:
        """i or j, whichever has fewer nodes on its side of the arc between them; both sides are walked in step."""
        walks = ((i, [(i, j)]), (j, [(j, i)]))
        while True:
            for end, stack in walks:
                if not stack:
                    return end
                v, back = stack.pop()
                for w in near[v]:
                    if w != back:
                        stack.append((w, v))

    hang(0, -1)
    tolerance = 1e-9 * max(1.0, float(np.abs(cost).max()))
    blocks = [(a, min(n, a + block)) for a in range(0, n, block)]
    at, calm = 0, 0
    while calm < len(blocks):
        a, z = blocks[at % len(blocks)]
        reduced = cost[a:z] - np.array(price[a:z])[:, None] - np.array(price[n:])[None, :]
        spot = int(reduced.argmin())
        i, j = a + spot // m, n + spot % m
        if reduced.flat[spot] >= -tolerance:
            at, calm = at + 1, calm + 1
            continue
        calm = 0
        # The cycle: i -> j, then from both ends up to where they meet. Flow on arcs left by a sink's side falls.
        u, v, up_i, up_j = i, j, [], []
        while u != v:
            if depth[u] >= depth[v]:
                up_i.append(u)
                u = parent[u]
            else:
                up_j.append(v)
                v = parent[v]
        falls = [(x, parent[x]) for x in up_i if x < n] + [(x, parent[x]) for x in up_j if x >= n]
        rises = [(x, parent[x]) for x in up_i if x >= n] + [(x, parent[x]) for x in up_j if x < n]
        out = min(falls, key=lambda e: near[e[0]][e[1]])
        theta = near[out[0]][out[1]]
        for x, p in falls:
            near[x][p] = near[p][x] = near[x][p] - theta
        for x, p in rises:
            near[x][p] = near[p][x] = near[x][p] + theta
        child, above = out
        del near[child][above], near[above][child]
        near[i][j] = near[j][i] = theta
        # The smaller part now hangs from the new arc; the other keeps its prices.
        parent[child] = -1
        inside = smaller(i, j)
        hang(inside, j if inside == i else i)
    prices = price
    return float(sum(s * p for s, p in zip(supply, prices[:n], strict=True)) + sum(d * p for d, p in zip(demand, prices[n:], strict=True)))


def emd_points(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Earth mover's distance of two weighted point sets (city-block), exact; weights are positive integers."""
    left, supply, right, demand = _net(np.asarray(a, float), np.asarray(wa), np.asarray(b, float), np.asarray(wb))
    if not supply:
        return 0.0
    if len(right) > len(left):  # the longer side in rows
        left, supply, right, demand = right, demand, left, supply
    cost = np.abs(left[:, None, :] - right[None, :, :]).sum(2)
    return transport_cost(cost, supply, demand) / (int(np.sum(wa)) * int(np.sum(wb)))


def emd_line(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Earth mover's distance on a line, for tests and small inputs."""
    points = np.unique(np.concatenate([a, b]))
    gap = lambda x, w: np.cumsum(np.bincount(np.searchsorted(points, x), w, len(points))) / np.sum(w)
    return float((np.abs(gap(a, wa) - gap(b, wb))[:-1] * np.diff(points)).sum())
