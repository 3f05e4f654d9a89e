"""Numeric kernels for one graph, one pair or one dendrogram at a time, in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np


def linkage(x: np.ndarray, method: str = "ward", condensed: bool = False) -> np.ndarray:
    """Merges (left, right, height, size) of vectors or of a square distance matrix.

    Nearest-neighbour chain with Lance-Williams updates; ward, average,
    complete and single. Leaves are 0..n-1, merge k is n + k, heights ascend.
    Ward and average of vectors need no distance matrix of them, the others do.
    """
    if method in ("ward", "average") and not condensed:
        return _dendrogram((_ward_merges if method == "ward" else _average_merges)(x), len(x), method)
    if condensed:
        d = np.array(x, float)
    else:
        g = x @ x.T
        sq = np.diag(g)
        d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * g, 0))
    if method == "ward":
        d *= d
    return _dendrogram(_matrix_merges(d, np.ones(len(d)), method), len(d), method)


def _matrix_merges(d: np.ndarray, size: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """(left, right, height) from a matrix of distances of clusters of such sizes, which is overwritten; ward: of squares."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    merges: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        row[a] = np.inf
        b = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
            chain = chain[:-2]
            i, j = min(a, b), max(a, b)
            merges.append((i, j, d[a, b]))
            na, nb = size[i], size[j]
            if method == "ward":
                new = ((na + size) * d[i] + (nb + size) * d[j] - size * d[i, j]) / (na + nb + size)
            elif method == "average":
                new = (na * d[i] + nb * d[j]) / (na + nb)
            else:
                new = np.maximum(d[i], d[j]) if method == "complete" else np.minimum(d[i], d[j])
            new[~alive] = np.inf
            new[i] = new[j] = np.inf
            d[i], d[:, i] = new, new
            alive[j] = False
            size[i] = na + nb
        else:
            chain.append(b)
    return merges


def _ward_merges(x: np.ndarray, block: tuple[int, int] = (512, 4096)) -> list[tuple[int, int, float]]:
    """(left, right, squared height) from centroids: all mutually nearest clusters merge at once.

    A merge is never nearer to a third cluster than its parts were, so only
    clusters whose nearest one merged look again, for a ``block`` of distances
    at a time. Equal vectors merge first.
    """
    if not len(x):
        return []
    c, at, size, merges = _distinct(x)
    sq = (c * c).sum(1)
    near, gap, look = np.zeros(len(c), int), np.full(len(c), np.inf), np.arange(len(c))
    while len(c) > 1:
        # squared distances by one product; halves of their harmonic weights are 1 / (1 / size + 1 / size)
        left, right, part = np.column_stack([-2 * c, sq, np.ones(len(c))]), np.column_stack([c, np.ones(len(c)), sq]).T, 1 / size
        held = np.empty((min(block[0], len(look)), block[1]))
        for low in range(0, len(look), block[0]):
            rows = look[low:low + block[0]]
            a, least, who, line = left[rows], np.full(len(rows), np.inf), np.zeros(len(rows), int), np.arange(len(rows))
            for first in range(0, len(c), block[1]):
                d = _product(a, right[:, first:first + block[1]], held)
                d /= part[rows, None] + part[first:first + block[1]]
                own = (rows >= first) & (rows < first + block[1])
                d[own, rows[own] - first] = np.inf
                k = d.argmin(1)
                better = d[line, k] < least
                least[better], who[better] = d[line, k][better], k[better] + first
            near[rows], gap[rows] = who, 2 * np.maximum(least, 0)
        i = np.flatnonzero((near[near] == np.arange(len(c))) & (near > np.arange(len(c))))
        if not len(i):  # a ring of equal distances
            i = gap.argmin(keepdims=True)
        j = near[i]
        merges += [(int(min(p)), int(max(p)), float(h)) for *p, h in zip(at[i], at[j], gap[i], strict=True)]
        c[i] = (size[i, None] * c[i] + size[j, None] * c[j]) / (size[i] + size[j])[:, None]
        size[i], sq[i] = size[i] + size[j], (c[i] * c[i]).sum(1)
        gone, changed = np.zeros((2, len(c)), bool)
        gone[j] = changed[i] = changed[j] = True
        again, left = changed | changed[near], np.flatnonzero(~gone)
        near = (np.cumsum(~gone) - 1)[near[left]]
        c, at, size, sq, gap, look = c[left], at[left], size[left], sq[left], gap[left], np.flatnonzero(again[left])
    return merges


def _product(a: np.ndarray, b: np.ndarray, held: np.ndarray) -> np.ndarray:
    """a @ b in the memory of ``held``."""
    return np.matmul(a, b, out=held.reshape(-1)[:len(a) * b.shape[1]].reshape(len(a), -1))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Distinct vectors around their mean, the first row of each, their counts, and the merges that make each one."""
    c, at, own, size = np.unique(x - x.mean(0), axis=0, return_index=True, return_inverse=True, return_counts=True)
    return c, at, size.astype(float), [(min(int(at[k]), i), max(int(at[k]), i), 0.0) for i, k in enumerate(own.ravel().tolist()) if i != at[k]]


def _average_merges(x: np.ndarray, most: int = 6000, block: tuple[int, int] = (128, 1024), search: Callable | None = None, finish: Callable | None = None) -> list[tuple[int, int, float]]:
    """(left, right, height): all clusters that are nearest to each other merge at once, by sums over their vectors.

    As in ``_ward_merges`` only those whose nearest one merged look again. No
    distance of two vectors is kept: a ``block`` of them is summed by cluster.
    From ``most`` clusters on their mean distances fit into a matrix.
    ``search`` and ``finish`` may do the work of ``_nearest`` and ``_finished``
    elsewhere; they get the distinct vectors, always the same, and the clusters.
    """
    if not len(x):
        return []
    c, at, weight, merges = _distinct(x)
    size, points, order = weight.copy(), np.ones(len(c), int), np.arange(len(c))  # by cluster: rows and distinct vectors; a cluster's vectors are successive in order
    near, gap, look = np.zeros(len(c), int), np.full(len(c), np.inf), np.arange(len(c))
    held = c, weight
    while len(size) > most:
        near[look], gap[look] = (search or _nearest)(held, order, points, size, look, block)
        i = np.flatnonzero((near[near] == np.arange(len(size))) & (near > np.arange(len(size))))
        if not len(i):  # a ring of equal distances
            i = gap.argmin(keepdims=True)
        j = near[i]
        merges += [(int(min(p)), int(max(p)), float(h)) for *p, h in zip(at[i], at[j], gap[i], strict=True)]
        changed, to = np.zeros(len(size), bool), np.arange(len(size))
        changed[i] = changed[j] = True
        to[j] = i
        left = np.flatnonzero(to == np.arange(len(size)))
        order = order[np.argsort(np.repeat(to, points), kind="stable")]
        size[i], points[i] = size[i] + size[j], points[i] + points[j]
        again, place = changed | changed[near], np.cumsum(to == np.arange(len(size))) - 1
        near = place[to[near]][left]
        at, size, points, gap, look = at[left], size[left], points[left], gap[left], np.flatnonzero(again[left])
    return merges + [(int(min(at[i], at[j])), int(max(at[i], at[j])), float(h)) for i, j, h in (finish or _finished)(held, order, points, size, block)]


def _nearest(held: tuple[np.ndarray, np.ndarray], order: np.ndarray, points: np.ndarray, size: np.ndarray, look: np.ndarray, block: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each of the clusters ``look`` the nearest one by mean distance, and that distance."""
    if len(order) == len(size):
        return _nearest_vectors(held[0][order], look, block)
    near, gap = [np.empty(0, int)], [np.empty(0)]
    for rows, mean in _mean_distances(held[0][order], held[1][order], points, size, look, block):
        line = np.arange(len(rows))
        mean[line, rows] = np.inf
        near.append(mean.argmin(1))
        gap.append(mean[line, near[-1]])
    return np.concatenate(near), np.concatenate(gap)


def _nearest_vectors(c: np.ndarray, look: np.ndarray, block: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The same where each cluster is one vector: by squares, and without a line of all distances."""
    sq, near, gap, held = (c * c).sum(1), np.zeros(len(look), int), np.full(len(look), np.inf), np.empty(block)
    right = np.column_stack([c, np.ones(len(c)), sq]).T
    for low in range(0, len(look), block[0]):
        rows = look[low:low + block[0]]
        a, line, mine = np.column_stack([-2 * c[rows], sq[rows], np.ones(len(rows))]), np.arange(len(rows)), slice(low, low + block[0])
        for first in range(0, len(c), block[1]):
            d = _product(a, right[:, first:first + block[1]], held)
            own = (rows >= first) & (rows < first + block[1])
            d[own, rows[own] - first] = np.inf
            k = d.argmin(1)
            better = d[line, k] < gap[mine]
            near[mine][better], gap[mine][better] = k[better] + first, d[line, k][better]
    return near, np.sqrt(np.maximum(gap, 0))


def _finished(held: tuple[np.ndarray, np.ndarray], order: np.ndarray, points: np.ndarray, size: np.ndarray, block: tuple[int, int]) -> list[tuple[int, int, float]]:
    """The merges of the clusters left, by a matrix of their mean distances."""
    d = np.empty((len(size), len(size)))
    for rows, mean in _mean_distances(held[0][order], held[1][order], points, size, np.arange(len(size)), block):
        d[rows] = mean
    return _matrix_merges(d, size.copy(), "average")


def _mean_distances(c: np.ndarray, weight: np.ndarray, points: np.ndarray, size: np.ndarray, look: np.ndarray, block: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of the clusters ``look``, in their order, and their mean distances to all clusters, again and again.

    Cluster k has the next ``points[k]`` of the vectors ``c``; ``size`` has sums of their ``weight``.
    """
    start, sq = np.append(0, np.cumsum(points)), (c * c).sum(1)
    right = np.column_stack([c, np.ones(len(c)), sq]).T
    single, even, own = len(c) == len(size), (weight == 1).all(), np.repeat(np.arange(len(size)), points)
    upto, low, held = np.append(0, np.cumsum(points[look])), 0, np.empty(block)
    while low < len(look):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + block[0], "right")) - 1)  # clusters of a block of vectors, or one larger
        rows = look[low:high]
        mine = np.concatenate([np.arange(start[k], start[k + 1]) for k in rows])
        sums = np.zeros((len(rows), len(size)))
        for at in range(0, len(mine), block[0]):
            part = mine[at:at + block[0]]
            a, member = np.column_stack([-2 * c[part], sq[part], np.ones(len(part))]), (own[part] == np.unique(own[part])[:, None]).astype(float)
            for first in range(0, len(c), block[1]):
                d = _product(a, right[:, first:first + block[1]], held)
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if not even:
                    d *= weight[part, None]
                    d *= weight[first:first + block[1]]
                if len(member) < len(part):
                    d = member @ d
                if single:
                    sums[:, first:first + block[1]] += d
                else:
                    clusters, begin = np.unique(own[first:first + block[1]], return_index=True)
                    sums[:, clusters[0]:clusters[-1] + 1] += np.add.reduceat(d, begin, 1)
        sums /= size[rows, None]
        sums /= size
        yield rows, sums
        low = high


def _dendrogram(merges: list[tuple[int, int, float]], n: int, method: str) -> np.ndarray:
    order = sorted(range(len(merges)), key=lambda k: merges[k][2])
    label, count = list(range(n)), [1] * n
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = np.zeros((max(n - 1, 0), 4))
    for k, m in enumerate(order):
        i, j, h = merges[m]
        a, b = root(i), root(j)
        out[k] = (min(label[a], label[b]), max(label[a], label[b]), math.sqrt(h) if method == "ward" else h, count[a] + count[b])
        up[b] = a
        label[a], count[a] = n + k, count[a] + count[b]
    return out


def flat_clusters(z: np.ndarray, height: float) -> np.ndarray:
    """Cluster numbers of the leaves when merges above ``height`` are undone."""
    n = len(z) + 1
    up = np.arange(2 * n - 1)
    for k, (a, b, h, _) in enumerate(z):
        if h <= height:
            up[int(a)] = up[int(b)] = n + k
    out = []
    for i in range(n):
        while up[i] != i:
            i = int(up[i])
        out.append(i)
    return np.unique(out, return_inverse=True)[1]


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least cost (square matrix).

    Shortest augmenting paths with potentials, one row at a time.
    """
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        match[n], j = i, n
        least, way, used = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while match[j] >= 0:
            used[j] = True
            r = match[j]
            free = ~used[:n]
            cur = cost[r] - u[r] - v[:n]
            better = free & (cur < least)
            least[better], way[better] = cur[better], j
            k = int(np.where(free, least, np.inf).argmin())
            delta = least[k]
            on = np.flatnonzero(used)
            u[match[on]] += delta
            v[on] -= delta
            least[free] -= delta
            j = k
        while j != n:
            before = way[j]
            match[j] = match[before]
            j = before
    out = np.empty(n, int)
    out[match[:n]] = np.arange(n)
    return out


def _sinkhorn(gradient: np.ndarray, reg: float, rounds: int = 200) -> np.ndarray:
    g = gradient / (np.abs(gradient).max() + 1e-12)
    k = np.exp(reg * (g - g.max()))
    r = np.ones(len(k))
    for _ in range(rounds):
        c = 1 / (k.T @ r)
        r_new = 1 / (k @ c)
        if np.abs(r_new - r).max() < 1e-9 * np.abs(r_new).max():
            r = r_new
            break
        r = r_new
    return r[:, None] * k * c[None]


def match_graphs(a: np.ndarray, b: np.ndarray, similarity: np.ndarray | None = None, seeds: tuple[tuple[int, int], ...] = (), transport: bool = True, rounds: int = 30, tol: float = 0.03) -> np.ndarray:
    """For each node of the smaller graph ``a`` its partner in ``b``.

    Relaxed quadratic assignment by Frank-Wolfe steps from the barycentre:
    a gradient, its projection (optimal transport or assignment), an exact line
    search, and one assignment at the end. Layers (first axis of 3-D input)
    add up; ``a`` is padded with zeros; seeds are kept.
    """
    a3, b3 = (x[None] if x.ndim == 2 else x for x in (np.asarray(a, float), np.asarray(b, float)))
    na, n = a3.shape[1], b3.shape[1]
    pad = np.zeros((len(a3), n, n))
    pad[:, :na, :na] = a3
    s = np.zeros((n, n))
    if similarity is not None:
        s[:na] = similarity
    p = np.full((n, n), 1 / n)

    def hold(m: np.ndarray) -> np.ndarray:
        for i, j in seeds:
            m[i], m[:, j] = 0, 0
            m[i, j] = 1
        return m

    def project(gradient: np.ndarray, exact: bool) -> np.ndarray:
        for i, j in seeds:
            gradient = gradient.copy()
            gradient[i], gradient[:, j] = gradient.min() - 1, gradient.min() - 1
            gradient[i, j] = gradient.max() + 1 + abs(gradient.max())
        if transport and not exact:
            return hold(_sinkhorn(gradient, 100.0))
        q = np.zeros((n, n))
        q[np.arange(n), assign(gradient.max() - gradient)] = 1
        return q

    p = hold(p)
    score = lambda x, y: float(sum(np.sum((l @ y) * (x @ m)) for l, m in zip(pad, b3, strict=True)))  # noqa: E731, E741
    for _ in range(rounds):
        g = s + sum(l @ p @ m.T + l.T @ p @ m for l, m in zip(pad, b3, strict=True))  # noqa: E741
        q = project(g, False)
        d = q - p
        quad, lin = score(d, d), score(d, p) + score(p, d) + float(np.sum(s * d))
        step = 1.0 if quad >= 0 and quad + lin > 0 else float(np.clip(-lin / (2 * quad), 0, 1)) if quad < 0 else 0.0
        p = p + step * d
        if step * np.linalg.norm(d) / math.sqrt(n) < tol:
            break
    return project(p, True).argmax(1)[:na]


def graph_distance(a: np.ndarray, b: np.ndarray, perm: np.ndarray, directed: bool = True) -> dict[str, float | bool]:
    """Distances of graphs of n <= m nodes under a matching.

    fnorm: Frobenius norm of the matched block; graph_edit_distance: differing
    and missing edge weight plus the difference of node counts, cut to an
    integer; euclidean_distance: over all of the larger graph; isexact: no
    matched cell of the larger is below the smaller's.
    """
    n, m = len(a), len(b)
    full = np.concatenate([perm, np.setdiff1d(np.arange(m), perm)])
    moved = b[np.ix_(full, full)]
    block = a - moved[:n, :n]
    pad = np.zeros((m, m))
    pad[:n, :n] = a
    scale = 1 if directed else 2
    edit = (np.abs(block).sum() + abs(moved.sum() - moved[:n, :n].sum())) / scale + abs(m - n)
    return {"fnorm": float(np.linalg.norm(block)), "graph_edit_distance": int(edit), "euclidean_distance": float(np.linalg.norm(pad - moved)), "isexact": bool((moved[:n, :n] >= a).all())}


def louvain(w: np.ndarray) -> np.ndarray:
    """Communities of an undirected weighted graph by greedy modularity, level by level."""
    label = np.arange(len(w))
    while True:
        n, total = len(w), w.sum()
        if total <= 0:
            return label
        k, own = w.sum(1), np.arange(n)
        weight = k.copy()
        moved, any_move = True, False
        while moved:
            moved = False
            for i in range(n):
                links = np.bincount(own, w[i], n)
                links[own[i]] -= w[i, i]
                weight[own[i]] -= k[i]
                gain = links - k[i] * weight / total
                best = int(gain.argmax())
                if gain[best] <= gain[own[i]] + 1e-12:
                    best = own[i]
                moved |= best != own[i]
                any_move |= best != own[i]
                own[i] = best
                weight[best] += k[i]
        kind, own = np.unique(own, return_inverse=True)
        label = own[label]
        if not any_move or len(kind) == n:
            return label
        fold = np.eye(len(kind))[own]
        w = fold.T @ w @ fold


def current_flow_betweenness(w: np.ndarray) -> np.ndarray:
    """Share of unit currents between all other pairs that pass each node (connected graph)."""
    n = len(w)
    if n < 3:
        return np.zeros(n)
    inv = np.linalg.pinv(np.diag(w.sum(1)) - w)
    out = np.zeros(n)
    for v in range(n):
        near = np.flatnonzero(w[v] > 0)
        for u in near:
            row = w[v, u] * (inv[v] - inv[u])
            rank = np.sort(row)
            k = np.arange(n)
            out[v] += ((2 * k - n + 1) * rank).sum()  # sum over pairs of |row_s - row_t|
    return (out / 2 - (n - 1) / 2) / ((n - 1) * (n - 2) / 2)


def betweenness(neighbours: list[list[int]]) -> np.ndarray:
    """Shortest-path betweenness of a directed graph, normalised by (n-1)(n-2)."""
    n = len(neighbours)
    out = np.zeros(n)
    for s in range(n):
        dist, paths, order, before = [-1] * n, [0.0] * n, [s], [[] for _ in range(n)]
        dist[s], paths[s] = 0, 1.0
        for v in order:
            for u in neighbours[v]:
                if dist[u] < 0:
                    dist[u] = dist[v] + 1
                    order.append(u)
                if dist[u] == dist[v] + 1:
                    paths[u] += paths[v]
                    before[u].append(v)
        part = [0.0] * n
        for v in reversed(order):
            for u in before[v]:
                part[u] += paths[u] / paths[v] * (1 + part[v])
            if v != s:
                out[v] += part[v]
    return out / max((n - 1) * (n - 2), 1)


def discriminants(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminant scalings and the share of between-class variance of each."""
    kinds, own = np.unique(y, return_inverse=True)
    means = np.array([x[own == k].mean(0) for k in range(len(kinds))])
    prior = np.bincount(own) / len(y)
    std = (x - means[own]).std(0)
    std[std == 0] = 1
    _, s, v = np.linalg.svd((x - means[own]) / std / math.sqrt(max(len(x) - len(kinds), 1)), full_matrices=False)
    rank = int((s > 1e-4 * s.max()).sum())
    scale = (v[:rank] / std).T / s[:rank]
    centred = (means - prior @ means) * np.sqrt(len(x) * prior / max(len(kinds) - 1, 1))[:, None]
    _, s, v = np.linalg.svd(centred @ scale, full_matrices=False)
    keep = int((s > 1e-4 * s.max()).sum())
    return scale @ v.T[:, :keep], (s**2 / (s**2).sum())[:keep]


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def ks_pvalue(d: float, n: int, m: int) -> float:
    """Two-sided p of the two-sample statistic, by the asymptotic series."""
    t = (math.sqrt(n * m / (n + m)) + 0.12 + 0.11 / math.sqrt(n * m / (n + m))) * d
    if t < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))))


def rank_sum_less(inside: np.ndarray, outside: np.ndarray) -> tuple[float, float]:
    """U and one-sided p (inside is smaller), with ties and continuity corrected."""
    both = np.concatenate([inside, outside])
    kinds, own, count = np.unique(both, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[own]
    n, m = len(inside), len(outside)
    u = rank[:n].sum() - n * (n + 1) / 2
    sd = math.sqrt(max(n * m / 12 * ((n + m + 1) - (count**3 - count).sum() / ((n + m) * max(n + m - 1, 1))), 1e-12))
    return float(u), normal_sf((n * m / 2 - u - 0.5) / sd)


def split_tests(blocks: Iterable[tuple[np.ndarray, np.ndarray]], total: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``rank_sum_less`` for each node c: cells of nodes both before or both after c against cells between them.

    A block has successive nodes, for each of them how many cells of each value
    (ascending) it has with nodes before and with nodes after it; ``total`` counts
    all cells. Yields U, p and whether both sides have a cell, block by block.
    """
    before, after = np.zeros(len(total)), total.astype(float)
    for low, high in blocks:
        below, above = np.cumsum(low, 0), np.cumsum(high, 0)
        inside = before + below - low + after - above
        between = total - inside - low - high
        before, after = before + below[-1], after - above[-1]
        n, m, both = inside.sum(1), between.sum(1), inside + between
        u = (inside * (np.cumsum(between, 1) - between / 2)).sum(1)
        size = n + m
        sd = np.sqrt(np.maximum(n * m / 12 * ((size + 1) - (both**3 - both).sum(1) / np.maximum(size * (size - 1), 1)), 1e-12))
        yield u, np.array([normal_sf(z) for z in (n * m / 2 - u - 0.5) / sd]), (n > 0) & (m > 0)


def difference_counts(x: np.ndarray, cells: int = 1 << 19) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Total and blocks for ``split_tests`` where a cell is the absolute difference of its nodes' ``x``.

    Cells are never made: a node's counts come from how often each number is
    before and after it. A block has about ``cells`` counts. Of the differences
    of any two numbers only the distinct ones are held.
    """
    kinds, own, often = np.unique(x, return_inverse=True, return_counts=True)
    values, step = np.zeros(0), max(1, cells // max(len(kinds), 1))
    for low in range(0, len(kinds), step):
        values = np.union1d(values, np.abs(kinds[low:low + step, None] - kinds))

    def place(k: int) -> np.ndarray:
        return np.searchsorted(values, np.abs(kinds - kinds[k]))

    total = np.zeros(len(values))
    for k in range(len(kinds)):
        np.add.at(total, place(k), often[k] * (often - (np.arange(len(kinds)) == k)).astype(float))

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen, step = np.zeros(len(kinds)), max(1, cells // max(len(values), 1))
        for start in range(0, len(x), step):
            part = own[start:start + step]
            mine = part[:, None] == np.arange(len(kinds))
            upto = seen + np.cumsum(mine, 0)
            low, high = np.zeros((2, len(part), len(values)))
            for k in np.unique(part):
                at = place(k)
                rows, order = np.flatnonzero(part == k), np.argsort(at, kind="stable")
                found, first = np.unique(at[order], return_index=True)
                for out, counts in ((low, upto - mine), (high, often - upto)):
                    out[np.ix_(rows, found)] = 2 * np.add.reduceat(counts[rows][:, order], first, axis=1)  # (i, j) and (j, i)
            seen = upto[-1]
            yield low, high

    return total, blocks()


def correlation_pvalue(r: float, n: int) -> float:
    """Two-sided p of a Pearson correlation of n pairs: the incomplete beta function at 1 - r^2."""
    if n < 3 or abs(r) >= 1:
        return 1.0 if n < 3 else 0.0
    return _beta_share((n - 2) / 2, 0.5, 1 - r * r)


def _beta_share(a: float, b: float, x: float) -> float:
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log1p(-x)) / a
    # Lentz's continued fraction
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f
