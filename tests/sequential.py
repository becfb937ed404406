"""Clustering of one small graph, node by node: what the rounds on edge tables are measured against."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np


def _pieces(nodes: list, links: dict) -> list[list]:
    """Connected parts of some nodes, direction aside."""
    left, out = set(nodes), []
    while left:
        part, todo = [], [min(left)]
        left.discard(todo[0])
        while todo:
            u = todo.pop()
            part.append(u)
            found = [v for v in links[u] if v in left]
            left.difference_update(found)
            todo += found
        out.append(part)
    return out


def modularity(i: np.ndarray, j: np.ndarray, w: np.ndarray, label: np.ndarray, resolution: float = 1.0) -> float:
    """Directed modularity of labels of nodes 0, 1, ..."""
    m, k = w.sum(), int(label.max()) + 1
    out, into = (np.bincount(label[x], weights=w, minlength=k) for x in (i, j))
    return float(w[label[i] == label[j]].sum() / m - resolution * (out * into).sum() / m**2)


def _moves(n: int, i, j, w, resolution: float, rng: np.random.Generator, label: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """Moves nodes to the neighbouring community with the largest gain until none moves.

    within: the refinement phase.  Nodes are alone at first, and only a node that is still alone moves, to a community
    inside its own group of `within`, if both are well connected to the rest of the group.
    """
    m = w.sum()
    k_out, k_in = np.bincount(i, weights=w, minlength=n), np.bincount(j, weights=w, minlength=n)
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), w.tolist(), strict=True):
        if a != b:
            near[a][b] += x
            near[b][a] += x
    c_out, c_in = np.bincount(label, weights=k_out, minlength=n), np.bincount(label, weights=k_in, minlength=n)
    if within is not None:
        return _refined(n, near, k_out, k_in, m, resolution, rng, within)
    moved = True
    least = 1e-10 * float((k_out + k_in).max())  # every move gains more than that, so there is an end
    while moved:
        moved = False
        for u in rng.permutation(n).tolist():
            own = int(label[u])
            c_out[own] -= k_out[u]
            c_in[own] -= k_in[u]
            weight: dict[int, float] = defaultdict(float)
            weight[own] += 0.0
            for v, x in near[u].items():
                weight[int(label[v])] += x
            gain = {c: x - resolution * (k_out[u] * c_in[c] + k_in[u] * c_out[c]) / m for c, x in weight.items()}
            best = max(gain, key=lambda c: (gain[c], -c))
            if gain[best] > gain[own] + least:
                label[u] = best
                moved = True
            c_out[label[u]] += k_out[u]
            c_in[label[u]] += k_in[u]
    return label


def _refined(n: int, near: list[dict[int, float]], k_out: np.ndarray, k_in: np.ndarray, m: float, resolution: float, rng: np.random.Generator, within: np.ndarray) -> np.ndarray:
    """Communities inside the groups of `within`, each of which is connected: single nodes merge into those with a gain."""
    label, alone = np.arange(n), np.ones(n, bool)
    g_out, g_in = np.bincount(within, weights=k_out, minlength=n), np.bincount(within, weights=k_in, minlength=n)
    c_out, c_in = k_out.astype(float), k_in.astype(float)
    rest = np.array([sum(x for v, x in near[u].items() if within[v] == within[u]) for u in range(n)])  # weight to the rest of its group, by community
    expected = lambda o, i_, g: resolution * (o * (g_in[g] - i_) + i_ * (g_out[g] - o)) / m
    for u in rng.permutation(n).tolist():
        g = int(within[u])
        if not alone[u] or rest[u] < expected(k_out[u], k_in[u], g) - 1e-12:
            continue
        weight: dict[int, float] = defaultdict(float)
        for v, x in near[u].items():
            if within[v] == g:
                weight[int(label[v])] += x
        gain = {c: x - resolution * (k_out[u] * c_in[c] + k_in[u] * c_out[c]) / m for c, x in weight.items() if c != u and rest[c] >= expected(c_out[c], c_in[c], g) - 1e-12}
        best = max(gain, key=lambda c: (gain[c], -c), default=None)
        if best is None or gain[best] < -1e-12:
            continue
        label[u] = best
        alone[u] = alone[best] = False
        c_out[best] += k_out[u]
        c_in[best] += k_in[u]
        rest[best] += rest[u] - 2 * weight[best]
    return label


def _contracted(new: np.ndarray, size: int, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges between groups of nodes."""
    pair, at = np.unique(new[a].astype(np.int64) * size + new[b], return_inverse=True)
    return pair // size, pair % size, np.bincount(at, weights=x)


def cluster(i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """Labels of nodes 0 to max by directed Leiden: moves of nodes, refinement inside the communities found, contraction
    of the refined ones, which start again in their communities; then every community is cut into connected parts.
    Labels go by size, largest first, then by least node."""
    n = int(max(i.max(), j.max())) + 1
    rng = np.random.default_rng(seed)
    node, a, b, x, size = np.arange(n), i, j, w, n  # node: of the contracted graph, of each node
    group = np.arange(n)
    while True:
        group = np.unique(_moves(size, a, b, x, resolution, rng, group), return_inverse=True)[1]
        if len(np.unique(group)) == size:
            break
        kinds, fine = np.unique(_moves(size, a, b, x, resolution, rng, np.arange(size), within=group), return_inverse=True)
        if len(kinds) == size:  # nothing left to contract below the communities: contract those
            kinds, fine = np.unique(group, return_inverse=True)
        coarse = np.zeros(len(kinds), np.int64)
        coarse[fine] = group
        node, group, size = fine[node], np.unique(coarse, return_inverse=True)[1], len(kinds)
        a, b, x = _contracted(fine, size, a, b, x)
    return _ordered(_connected(group[node], i, j))


def multilevel(i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """Levels of moves and contraction without refinement, on the graph without direction."""
    i, j, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w]) / 2
    n = int(i.max()) + 1
    rng = np.random.default_rng(seed)
    label, a, b, x, size = np.arange(n), i, j, w, n
    while True:
        kinds, new = np.unique(_moves(size, a, b, x, resolution, rng, np.arange(size)), return_inverse=True)
        label = new[label]
        if len(kinds) == size:
            return _ordered(label)
        a, b, x = _contracted(new, len(kinds), a, b, x)
        size = len(kinds)


def greedy_modularity(i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0) -> np.ndarray:
    """Merges, from single nodes of the graph without direction, the two linked communities with the largest gain until
    none has one."""
    n = int(max(i.max(), j.max())) + 1
    m = w.sum()
    label, a, b, x = np.arange(n), np.minimum(i, j), np.maximum(i, j), w
    while True:
        size = int(label.max()) + 1
        k = np.bincount(np.concatenate([a, b]), weights=np.concatenate([x, x]), minlength=size) / 2
        p, q, y = _contracted(np.arange(size), size, a, b, x)
        gain = np.where(p != q, y / m - resolution * 2 * k[p] * k[q] / m**2, -1.0)
        best = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[best] <= 1e-12:
            return _ordered(label)
        new = np.arange(size)
        new[q[best]] = p[best]
        new = np.unique(new, return_inverse=True)[1]
        label, a, b, x = new[label], np.minimum(new[p], new[q]), np.maximum(new[p], new[q]), y


def _connected(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    links: dict[int, list[int]] = defaultdict(list)
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        if label[p] == label[q]:
            links[p].append(q)
            links[q].append(p)
    out, next_ = label.copy(), 0
    for c in np.unique(label):
        for part in _pieces(np.flatnonzero(label == c).tolist(), links):
            out[part] = next_
            next_ += 1
    return out


def _ordered(label: np.ndarray) -> np.ndarray:
    kinds, first, at, size = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((first, -size))] = np.arange(len(kinds))
    return rank[at]


def _flow(n: int, i, j, w, rounds: int = 100, teleport: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """(visit rate of each node, flow of each edge) of a random walk with teleportation."""
    out = np.bincount(i, weights=w, minlength=n)
    p = np.full(n, 1 / n)
    for _ in range(rounds):
        step = np.bincount(j, weights=p[i] * w / out[i], minlength=n)
        p = teleport / n + (1 - teleport) * (step + p[out == 0].sum() / n)
    return p, p[i] * w / out[i]


def _plogp(x):
    x = np.maximum(x, 0.0)
    return x * np.log2(np.where(x > 0, x, 1.0))


def _code_length(label: np.ndarray, i, j, p: np.ndarray, flow: np.ndarray) -> float:
    """Description length (bits a step) of the walk under the two-level code of the labels."""
    k = int(label.max()) + 1
    exit_ = np.bincount(label[i], weights=np.where(label[i] != label[j], flow, 0.0), minlength=k)
    rate = np.bincount(label, weights=p, minlength=k)
    return float(_plogp(exit_.sum()) - 2 * _plogp(exit_).sum() - _plogp(p).sum() + _plogp(exit_ + rate).sum())


def _merged(label: np.ndarray, i, j, p: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Merges the two linked communities that shorten the code most until no pair does."""
    label = np.unique(label, return_inverse=True)[1]
    while True:
        k = int(label.max()) + 1
        a, b = label[i], label[j]
        out = a != b
        if not out.any():
            return label
        exit_ = np.bincount(a[out], weights=flow[out], minlength=k)
        rate = np.bincount(label, weights=p, minlength=k)
        pair, at = np.unique(np.minimum(a, b)[out].astype(np.int64) * k + np.maximum(a, b)[out], return_inverse=True)
        between = np.bincount(at, weights=flow[out])
        x, y = pair // k, pair % k
        total, both = exit_.sum(), exit_[x] + exit_[y] - between
        apart = -2 * _plogp(exit_) + _plogp(exit_ + rate)
        change = _plogp(total - between) - _plogp(total) - 2 * _plogp(both) + _plogp(both + rate[x] + rate[y]) - apart[x] - apart[y]
        best = int(np.argmin(change))
        if change[best] >= -1e-12:
            return label
        label = np.where(label == y[best], x[best], label)
        label = np.unique(label, return_inverse=True)[1]


def _moved(label: np.ndarray, i, j, p: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Moves nodes to the neighbouring community that shortens the code most until no move does."""
    label = label.copy()
    k = int(label.max()) + 1
    log = lambda x: x * math.log2(x) if x > 0 else 0.0
    go: list[dict[int, float]] = [defaultdict(float) for _ in label]
    come: list[dict[int, float]] = [defaultdict(float) for _ in label]
    for a, b, f in zip(i.tolist(), j.tolist(), flow.tolist(), strict=True):
        if a != b:
            go[a][b] += f
            come[b][a] += f
    out = [sum(x.values()) for x in go]
    exit_ = np.bincount(label[i], weights=np.where(label[i] != label[j], flow, 0.0), minlength=k).tolist()
    rate = np.bincount(label, weights=p, minlength=k).tolist()
    of, visits, total, better = label.tolist(), p.tolist(), sum(exit_), True
    while better:
        better = False
        for u in range(len(of)):
            own = of[u]
            to: dict[int, float] = defaultdict(float)
            back: dict[int, float] = defaultdict(float)
            for v, f in go[u].items():
                to[of[v]] += f
            for v, f in come[u].items():
                back[of[v]] += f
            left = exit_[own] - (out[u] - to[own]) + back[own]
            gone = -2 * log(left) + log(left + rate[own] - visits[u]) + 2 * log(exit_[own]) - log(exit_[own] + rate[own])
            best = None
            for c in sorted((set(to) | set(back)) - {own}):
                new = exit_[c] + (out[u] - to[c]) - back[c]
                sum_ = total - exit_[own] - exit_[c] + left + new
                change = gone + log(sum_) - log(total) - 2 * log(new) + log(new + rate[c] + visits[u]) + 2 * log(exit_[c]) - log(exit_[c] + rate[c])
                if change < -1e-12 and (best is None or change < best[0]):
                    best = (change, c, new, sum_)
            if best:
                _, c, new, total = best
                exit_[own], exit_[c] = max(left, 0.0), max(new, 0.0)
                rate[own] -= visits[u]
                rate[c] += visits[u]
                of[u], better = c, True
    return np.unique(of, return_inverse=True)[1]


def map_equation(i, j, w, seed: int = 42) -> np.ndarray:
    """Two-level map equation: from the best of four modularity clusterings, moves nodes and merges communities until
    neither a move nor a merge shortens the description of a random walk."""
    n = int(max(i.max(), j.max())) + 1
    p, flow = _flow(n, i, j, w)
    best = min((cluster(i, j, w, r, seed) for r in (0.25, 0.5, 1.0, 2.0)), key=lambda x: _code_length(x, i, j, p, flow))
    score = _code_length(best, i, j, p, flow)
    while True:
        trial = _connected(_merged(_moved(best, i, j, p, flow), i, j, p, flow), i, j)
        if (s := _code_length(trial, i, j, p, flow)) >= score - 1e-12:
            break
        best, score = trial, s
    return _ordered(best)
