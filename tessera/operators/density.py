"""Hierarchical density clustering of one distance matrix (Campello, Moulavi and Sander, 2013)."""

from __future__ import annotations

import numpy as np


def spanning_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """The edges of a minimum spanning tree, shortest first."""
    n = len(d)
    near, via = d[0].copy(), np.zeros(n, int)
    inside = np.zeros(n, bool)
    inside[0] = True
    out = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, near)))
        out.append((float(near[j]), int(via[j]), j))
        inside[j] = True
        closer = ~inside & (d[j] < near)
        near[closer], via[closer] = d[j][closer], j
    return sorted(out, key=lambda e: e[0])


def hdbscan(d: np.ndarray, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, strengths) of the points of a distance matrix; noise is -1, 0.

    Distances are raised to both ends' distance to their ``min_size``-th
    neighbour (themselves the first). The tree of their single linkage is
    condensed to splits into two groups of ``min_size`` or more, and those
    clusters are taken that live longest, the whole never. A point's strength
    is how long it stays, against the longest in its cluster.
    """
    n = len(d)
    if n < 2:
        return np.full(n, -1), np.zeros(n)
    k = min(max(1, min_size), n)
    core = np.partition(d, k - 1, axis=1)[:, k - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    tree = spanning_tree(reach)

    # single linkage: node n + i joins two nodes at a height
    root, left, right, height = list(range(n)), {}, {}, {}
    size = {i: 1 for i in range(n)}
    top = list(range(n))  # of a set's representative

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (w, a, b) in enumerate(tree):
        a, b = find(a), find(b)
        left[n + i], right[n + i], height[n + i] = top[a], top[b], w
        size[n + i] = size[top[a]] + size[top[b]]
        root[b], top[a] = a, n + i

    def points(node: int) -> list[int]:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += [left[x], right[x]]
        return out

    # condense: clusters are numbered from 0, the whole
    parent, birth, fell, into = {0: -1}, {0: 0.0}, {}, {}
    stable: dict[int, float] = {0: 0.0}
    longest: dict[int, float] = {0: 0.0}
    todo = [(n + len(tree) - 1, 0)]

    def leave(c: int, at: float, count: int) -> None:
        gain = at - birth[c]
        stable[c] += 0.0 if np.isnan(gain) else gain * count
        longest[c] = max(longest[c], at)

    while todo:
        node, c = todo.pop()
        if node < n:
            fell[node], into[node] = np.inf, c
            leave(c, np.inf, 1)
            continue
        at = 1.0 / height[node] if height[node] > 0 else np.inf
        sides = (left[node], right[node])
        large = [x for x in sides if size[x] >= min_size]
        if len(large) == 2:
            for x in sides:
                new = len(parent)
                parent[new], birth[new], stable[new], longest[new] = c, at, 0.0, 0.0
                leave(c, at, size[x])
                todo.append((x, new))
            continue
        for x in sides:
            if x in large:
                todo.append((x, c))
            else:
                for p in points(x):
                    fell[p], into[p] = at, c
                    leave(c, at, 1)

    below: dict[int, list[int]] = {c: [] for c in parent}
    for c, up in parent.items():
        if up >= 0:
            below[up].append(c)
    taken, worth = set(), dict(stable)
    for c in sorted(parent, reverse=True):  # a cluster's number is above its parent's
        if c == 0:
            continue
        under = sum(worth[x] for x in below[c])
        if below[c] and under > stable[c]:
            worth[c] = under
            continue
        taken.add(c)
        drop = list(below[c])
        while drop:
            x = drop.pop()
            taken.discard(x)
            drop += below[x]

    name = {c: i for i, c in enumerate(sorted(taken))}
    labels, strength = np.full(n, -1), np.zeros(n)
    for p in range(n):
        c = into[p]
        while c >= 0 and c not in name:
            c = parent[c]
        if c >= 0:
            labels[p] = name[c]
            most = longest[c]
            strength[p] = 1.0 if most == 0 or np.isinf(fell[p]) else min(fell[p], most) / most
    return labels, strength
