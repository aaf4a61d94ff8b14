"""Exact minimum cut of small two-label problems, as used to label the lines of one page.

Energy: ``sum(cost1[i] if label[i] else cost0[i]) + sum(w for i, j, w in edges if label[i] != label[j])``.
A node whose two costs differ by more than the weight of all its edges keeps its cheaper label in every optimum, so it is fixed
first and its edges become costs of its neighbours; what remains is solved by augmenting paths (maximum flow).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence


def label(cost0: Sequence[float], cost1: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[int]:
    """Optimal labels (0 or 1). Empty input gives ``[]``; a tie takes label 0. Edge weights must not be negative."""
    n = len(cost0)
    gap = [cost0[i] - cost1[i] for i in range(n)]  # > 0: wants 1
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    out = [-1] * n
    free = [sum(x.values()) for x in near]
    todo = [i for i in range(n) if abs(gap[i]) >= free[i]]
    while todo:
        i = todo.pop()
        if out[i] >= 0:
            continue
        out[i] = 1 if gap[i] > 0 else 0
        for j, w in near[i].items():
            if out[j] < 0:
                gap[j] += w if out[i] else -w
                free[j] -= w
                if abs(gap[j]) >= free[j] - 1e-12:
                    todo.append(j)
    rest = [i for i in range(n) if out[i] < 0]
    if rest:
        _flow(rest, gap, near, out)
    return out


def _flow(rest: list[int], gap: list[float], near: list[dict[int, float]], out: list[int]) -> None:
    """Maximum flow over the undecided nodes; those that the source still reaches get label 1."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {s: {}, t: {}}
    for i in rest:
        cap[i] = {j: w for j, w in near[i].items() if out[j] < 0}
    for i in rest:
        if gap[i] > 0:
            cap[s][i], cap[i][s] = gap[i], 0.0
        elif gap[i] < 0:
            cap[i][t], cap[t][i] = -gap[i], 0.0
    while True:
        before: dict[int, int] = {s: s}
        queue = deque([s])
        while queue and t not in before:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in before:
                    before[v] = u
                    queue.append(v)
        if t not in before:
            break
        room, v = float("inf"), t
        while v != s:
            room, v = min(room, cap[before[v]][v]), before[v]
        v = t
        while v != s:
            u = before[v]
            cap[u][v] -= room
            cap[v][u] = cap[v].get(u, 0.0) + room
            v = u
    for i in rest:
        out[i] = 1 if i in before else 0
