"""Numerical kernels of one group, in numpy. They know nothing of Spark."""

from __future__ import annotations

import heapq
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Values of an array in which pairs of rows are looked at.
BLOCK = 1 << 21

# ---- superposition


def superpose(p: np.ndarray, q: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proper rotations and shifts that bring p onto q: p @ r + t. p, q: (n, 3); weights: (f, n) or None -> (f, 3, 3), (f, 3)."""
    w = np.ones((1, len(p))) if weights is None else np.atleast_2d(weights).astype(float)
    total = w.sum(1)[:, None]
    cp, cq = w @ p / total, w @ q / total
    c = np.einsum("fn,ni,nj->fij", w, p, q) - total[:, :, None] * cp[:, :, None] * cq[:, None, :]
    u, _, vt = np.linalg.svd(c)
    u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
    r = u @ vt
    return r, cq - np.einsum("fi,fij->fj", cp, r)


def rmsd(p: np.ndarray, q: np.ndarray) -> float:
    r, t = superpose(p, q)
    return float(np.sqrt(((p @ r[0] + t[0] - q) ** 2).sum() / len(p)))


def rmsd_block(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray, rows: int = 32) -> np.ndarray:
    """RMSD of every model of a (3, rows, n: centred coordinates; sums of squares) with every one of b, by the closed form of `columns.superposed_rmsd`, some rows at a time."""
    out = np.empty((a.shape[1], b.shape[1]))
    for s in range(0, out.shape[0], rows):
        for t in range(0, out.shape[1], 1024):
            own, other = slice(s, s + rows), slice(t, t + 1024)
            c = [[a[i, own] @ b[j, other].T for j in range(3)] for i in range(3)]
            out[own, other] = _closed_form(c, ea[own, None] + eb[other], a.shape[2])
    return out


def _det(m):
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def _closed_form(c, e: np.ndarray, n: int) -> np.ndarray:
    g = [[None] * 3 for _ in range(3)]
    for i in range(3):
        for j in range(i, 3):
            g[i][j] = g[j][i] = c[0][i] * c[0][j] + c[1][i] * c[1][j] + c[2][i] * c[2][j]
    mean = (g[0][0] + g[1][1] + g[2][2]) / 3
    for i in range(3):
        g[i][i] = g[i][i] - mean
    p2 = (g[0][0] * g[0][0] + g[1][1] * g[1][1] + g[2][2] * g[2][2] + 2 * (g[0][1] * g[0][1] + g[0][2] * g[0][2] + g[1][2] * g[1][2])) / 6
    p = np.sqrt(np.maximum(p2, 0))
    cube = p * p * p
    half = np.divide(_det(g) / 2, cube, out=np.ones_like(p), where=cube > 0)
    # The angle is within 0 and 60 degrees, so one cosine tells those of the angles 120 degrees before and after it.
    cos = np.cos(np.arccos(np.clip(half, -1, 1)) / 3)
    side = np.sqrt(np.maximum(3 - 3 * cos * cos, 0))
    root = lambda twice: np.sqrt(np.maximum(mean + p * twice, 0))
    total = root(2 * cos) + root(side - cos) + np.sign(_det(c)) * root(-side - cos)
    return np.sqrt(np.maximum((e - 2 * total) / n, 0))


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Doubles rounded as Spark's `round` does: halves of the shortest decimal away from 0."""
    size = np.abs(values) * 10.0**digits
    # Beyond that a double has no digit to round.
    whole = ~(size < 1 << 52)
    up = np.floor(size + 0.5)
    out = np.where(whole, values, np.copysign(up, values) / 10.0**digits) + 0.0
    for at in zip(*np.nonzero(~whole & (np.abs(size - np.floor(size) - 0.5) <= 1e-15 * size)), strict=True):
        out[at] = float(Decimal(repr(float(values[at]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def rmsd_condensed(x: np.ndarray, e: np.ndarray, rows: int = 32) -> np.ndarray:
    """The upper half of the RMSD of models (3, models, n), row after row."""
    m = x.shape[1]
    out, at = np.empty(m * (m - 1) // 2), 0
    for s in range(0, m, rows):
        block = rmsd_block(x[:, s : s + rows], e[s : s + rows], x[:, s:], e[s:], rows)
        for k, r in enumerate(block):
            out[at : at + m - s - k - 1] = r[k + 1 :]
            at += m - s - k - 1
    return out


def align_all(models: np.ndarray, reference: int = 0) -> np.ndarray:
    """Every model (m, n, 3) brought onto one of them."""
    out = np.empty_like(models, dtype=float)
    for k, m in enumerate(models):
        r, t = superpose(m, models[reference])
        out[k] = m @ r[0] + t[0]
    return out


def distance_matrix(x: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - x[None, :, :]
    return np.sqrt((d * d).sum(-1))


# ---- hierarchical clustering


def condensed(distances: np.ndarray) -> np.ndarray:
    """The upper half of a square matrix, row after row; each entry is the mean of both halves."""
    n = len(distances)
    d = np.asarray(distances, float)
    return np.concatenate([np.zeros(0), *((d[i, i + 1 :] + d[i + 1 :, i]) / 2 for i in range(n - 1))])


def linkage(distances: np.ndarray, method: str = "average") -> np.ndarray:
    """`agglomerate` of a square distance matrix."""
    return agglomerate(condensed(distances), len(distances), method)


def agglomerate(c: np.ndarray, n: int, method: str = "average", sizes: np.ndarray | None = None) -> np.ndarray:
    """Agglomeration of n items from the upper half of their distances, which is used up: rows (a, b, height, size); new clusters are n, n + 1, ... method: average or ward. sizes: of items that are clusters.

    Ties fall to the pair with the smallest members. Each cluster keeps its
    nearest one of those after it, so a merge looks at one row of the matrix
    and at the few clusters whose nearest was a part of it: O(n^2) in all but
    contrived cases. Memory is that half of the matrix.
    """
    k = np.arange(n, dtype=np.int64)
    start = k * n - k * (k + 1) // 2 - k - 1
    ids, size = list(range(n)), np.ones(n) if sizes is None else sizes.astype(float)
    out = np.empty((max(n - 1, 0), 4))
    near, least = np.zeros(n, int), np.full(n, np.inf)

    def row(i):
        return np.concatenate((c[start[:i] + i], [np.inf], c[start[i] + i + 1 : start[i] + n]))

    def put(i, values):
        c[start[:i] + i], c[start[i] + i + 1 : start[i] + n] = values[:i], values[i + 1 :]

    def look(i):
        if i + 1 < n:
            near[i] = i + 1 + int(np.argmin(c[start[i] + i + 1 : start[i] + n]))
            least[i] = c[start[i] + near[i]]
        else:
            least[i] = np.inf

    for i in range(n):
        look(i)
    for step in range(n - 1):
        i = int(np.argmin(least))
        j = int(near[i])
        h = c[start[i] + j]
        out[step] = (*sorted((ids[i], ids[j])), h, size[i] + size[j])
        di, dj = row(i), row(j)
        others = np.isfinite(di) & np.isfinite(dj)
        if method == "average":
            new = (size[i] * di + size[j] * dj) / (size[i] + size[j])
        else:
            s = size + size[i] + size[j]
            new = np.sqrt(np.maximum(((size + size[i]) * di**2 + (size + size[j]) * dj**2 - size * h * h), 0) / s, where=others, out=np.full(n, np.inf))
        new = np.where(others, new, np.inf)
        put(j, np.full(n, np.inf))
        put(i, new)
        least[j] = np.inf
        ids[i], size[i] = n + step, size[i] + size[j]
        look(i)
        before = np.arange(i)
        closer = before[(new[:i] < least[:i]) | (new[:i] == least[:i]) & (near[:i] > i)]
        near[closer], least[closer] = i, new[closer]
        # Whose nearest is gone, or has moved away, looks again.
        for k in np.flatnonzero(np.isfinite(least) & ((near == j) | (near == i))):
            if k != i and (near[k] == j or new[k] > least[k]):
                look(k)
    return out


#: Clusters whose half matrix is held in memory (1.6 GB), and models of a tile before that.
HELD, TILE = 20000, 2048


def agglomerate_models(x: np.ndarray, e: np.ndarray, method: str = "average", held: int | None = None) -> np.ndarray:
    """`agglomerate` by the RMSD of models (3, models, n), in memory that does not grow with the square of their number.

    Up to `held` models their half matrix is there. With more, clusters that
    are each other's nearest are merged, all of a round at once, until so few
    are left: both methods bring no cluster nearer by merging others, so these
    merges are in the tree whatever comes before them. A round computes the
    distances anew, tile by tile, and keeps each cluster's nearest one. The
    distance of two clusters follows from the sum of their models' distances
    (ward: their squares).
    """
    n, held = x.shape[1], held or HELD
    if n <= held:
        return agglomerate(rmsd_condensed(x, e), n, method)
    members, within, merges = [np.array([k]) for k in range(n)], np.zeros(n), []
    while len(members) > held:
        near, least, total = _nearest_clusters(x, e, members, within, method)
        pairs = [(k, int(near[k])) for k in np.flatnonzero(near[near] == np.arange(len(near))) if k < near[k]]
        if not pairs:
            # Sums of another order may differ in their last digit; the nearest of all are a pair.
            k = int(np.argmin(least))
            pairs = [tuple(sorted((k, int(near[k]))))]
        merges += [(members[a][0], members[b][0], least[a], len(members[a]) + len(members[b])) for a, b in pairs]
        for a, b in pairs:
            members[a] = np.sort(np.concatenate((members[a], members[b])))
            within[a] += within[b] + 2 * total[a]
        gone = {b for _, b in pairs}
        left = [k for k in range(len(members)) if k not in gone]
        members, within = [members[k] for k in left], within[left]
    m = len(members)
    c = np.empty(m * (m - 1) // 2)
    for i, j, d, _ in _cluster_distances(x, e, members, within, method):
        for k, row in zip(range(i.start, i.stop), d, strict=True):
            lo = max(j.start, k + 1)
            at = k * m - k * (k + 1) // 2 - k - 1
            c[at + lo : at + j.stop] = row[lo - j.start :]
    first = [int(v[0]) for v in members]
    for a, b, h, s in agglomerate(c, m, method, np.array([len(v) for v in members])):
        one, two = sorted((first[int(a)], first[int(b)]))
        merges.append((one, two, h, s))
        first.append(one)
    return _in_order(merges, n)


def _cluster_distances(x, e, members, within, method):
    """(clusters of a tile, of a tile that is not before it, their distances, sums of their models' distances), for every two tiles. members: models of each cluster, rising."""
    size = np.array([len(v) for v in members])
    order, begin = np.concatenate(members), np.append(0, np.cumsum(size))
    owner = np.repeat(np.arange(len(size)), size)
    edges = [0]
    while edges[-1] < len(size):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(begin, begin[edges[-1]] + TILE, "right")) - 1))
    tiles = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    own = within / size.astype(float) ** 2
    for k, i in enumerate(tiles):
        for j in tiles[k:]:
            cols = order[begin[j.start] : begin[j.stop]]
            total = np.zeros((i.stop - i.start, j.stop - j.start))
            for s in range(begin[i.start], begin[i.stop], 256):
                rows = order[s : min(s + 256, begin[i.stop])]
                d = rmsd_block(x[:, rows], e[rows], x[:, cols], e[cols])
                d = np.add.reduceat(d if method == "average" else d * d, begin[j.start : j.stop] - begin[j.start], axis=1)
                of = owner[s : s + len(rows)] - i.start
                at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                total[of[at]] += np.add.reduceat(d, at, axis=0)
            a, b = size[i, None].astype(float), size[j].astype(float)
            mean = total / (a * b)
            yield i, j, mean if method == "average" else np.sqrt(np.maximum((2 * mean - own[i, None] - own[j]) * (a * b / (a + b)), 0)), total


def _nearest_clusters(x, e, members, within, method):
    """(nearest cluster of each, distance, sum); of those as near the first."""
    m = len(members)
    near, least, total = np.zeros(m, int), np.full(m, np.inf), np.zeros(m)
    for i, j, d, sums in _cluster_distances(x, e, members, within, method):
        if i == j:
            np.fill_diagonal(d, np.inf)
        for one, other, d, sums in ((i, j, d, sums), *([] if i == j else [(j, i, d.T, sums.T)])):
            at, rows = d.argmin(1), np.arange(len(d))
            k = np.flatnonzero(d[rows, at] < least[one])
            places = one.start + k
            near[places], least[places], total[places] = other.start + at[k], d[k, at[k]], sums[k, at[k]]
    return near, least, total


def _in_order(merges: list, n: int) -> np.ndarray:
    """Rows (a, b, height, size) of merges (first members, height, size), lowest first, clusters after their parts."""
    last, waits, after = {}, [0] * len(merges), [[] for _ in merges]
    for k, (a, b, _, _) in enumerate(merges):
        for part in (last.get(a), last.get(b)):
            if part is not None:
                waits[k] += 1
                after[part].append(k)
        last[a] = k
    ready = [(merges[k][2], merges[k][0], merges[k][1], k) for k in range(len(merges)) if not waits[k]]
    heapq.heapify(ready)
    ids, out = list(range(n)), np.empty((len(merges), 4))
    for step in range(len(merges)):
        h, a, b, k = heapq.heappop(ready)
        out[step] = (*sorted((ids[a], ids[b])), h, merges[k][3])
        ids[a] = n + step
        for following in after[k]:
            waits[following] -= 1
            if not waits[following]:
                heapq.heappush(ready, (merges[following][2], merges[following][0], merges[following][1], following))
    return out


def cut_tree(tree: np.ndarray, n: int, height: float) -> np.ndarray:
    """Cluster of each item, 1-based in the order of the clusters' smallest members; merges up to `height` count."""
    parent = list(range(n + len(tree)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, b, h, _) in enumerate(tree):
        if h <= height:
            parent[root(int(a))] = parent[root(int(b))] = n + k
    return canonical(np.array([root(i) for i in range(n)]))


def canonical(labels: np.ndarray, first: int = 1) -> np.ndarray:
    """Labels renumbered in order of first appearance."""
    seen: dict = {}
    return np.array([seen.setdefault(x, len(seen) + first) for x in labels.tolist()])


# ---- k-means, silhouette, spectral clustering


def kmeans(x: np.ndarray, k: int, seed: int = 0, restarts: int = 10, rounds: int = 300) -> np.ndarray:
    """Labels by Lloyd's algorithm from k-means++ starts; the best of `restarts`."""
    rng, best, out = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(restarts):
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centres, float)
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            label = d.argmin(1)
            new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(1).sum()
        if cost < best - 1e-12:
            best, out = cost, label
    return canonical(out, 0)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean Euclidean silhouette; None where it is not defined."""
    kinds = np.unique(labels)
    if not 2 <= len(kinds) <= len(x) - 1:
        return None
    to = np.empty((len(x), len(kinds)))
    # Some rows at a time: the distances of all are never there together.
    step = max(1, BLOCK // x.size)
    for r in range(0, len(x), step):
        d = np.sqrt(((x[r : r + step, None] - x[None]) ** 2).sum(-1))
        to[r : r + step] = np.stack([d[:, labels == k].sum(1) for k in kinds], axis=1)
    count = np.array([(labels == k).sum() for k in kinds])
    own = np.searchsorted(kinds, labels)
    rows = np.arange(len(x))
    alone = count[own] == 1
    a = to[rows, own] / np.maximum(count[own] - 1, 1)
    mean = to / count
    mean[rows, own] = np.inf
    b = mean.min(1)
    s = np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
    return float(s.mean())


def spectral(affinity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Labels from the k leading vectors of the normalised affinity."""
    degree = affinity.sum(1)
    scale = 1 / np.sqrt(np.where(degree > 0, degree, 1.0))
    _, v = np.linalg.eigh(scale[:, None] * affinity * scale[None, :])
    return kmeans(fix_signs(v[:, ::-1][:, :k]) * scale[:, None], k, seed)


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    top = np.abs(vectors).argmax(0)
    sign = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


# ---- domains from difference distances


def domains(rms: np.ndarray, largest: np.ndarray, separation: int = 5, k: int | None = None, seed: int = 0) -> tuple[np.ndarray, int, float | None]:
    """(label of each residue, number of domains, silhouette) from the aggregated difference matrices of a chain.

    A residue is the row of both matrices, near residues left out; rows alike
    in direction move alike. Without motion the chain is one domain. Of the
    numbers of domains tried the one of the largest silhouette is taken, of
    equal ones the smallest.
    """
    n = len(rms)
    for m in (rms, largest):
        if not np.allclose(m, m.T, atol=1e-6) or not np.allclose(m.diagonal(), 0, atol=1e-6):
            raise ValueError("a difference matrix must be symmetric with a zero diagonal")
    residue = np.arange(n)
    near = np.abs(residue[:, None] - residue) < separation
    rows = np.concatenate([np.where(near, 0.0, m) for m in (rms, largest)], axis=1)
    length = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    if not length.any():
        return np.zeros(n, int), 1, None
    direction = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    alike = np.clip(direction @ direction.T, 0, None)
    alike[residue, residue] = 1.0
    found = []
    for count in [k] if k else [2, 3, 4]:
        if count <= n:
            label = spectral(alike, count, seed)
            found.append((label, count, silhouette(rows, label)))
    defined = [f for f in found if f[2] is not None]
    return max(defined, key=lambda f: f[2]) if defined else found[0] if found else (np.zeros(n, int), 1, None)


# ---- principal components


def data_matrix(models: np.ndarray, scaled: bool = False) -> np.ndarray:
    """Coordinates (3n, m), each row around 0; scaled: divided by its sample deviation (0 counts as 1)."""
    a = models.reshape(len(models), -1).T.astype(float)
    a = a - a.mean(1, keepdims=True)
    if scaled:
        s = a.std(1, ddof=1, keepdims=True)
        a = a / np.where(s == 0, 1, s)
    return a


def principal_components(a: np.ndarray, normalise: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, vectors, scores) of a a', falling; the smaller Gram matrix is solved. normalise: divided by models - 1."""
    rows, m = a.shape
    if m < rows:
        values, w = np.linalg.eigh(a.T @ a)
        values, w = np.maximum(values[::-1], 0), w[:, ::-1]
        keep = values > 1e-12 * max(values[0], 1e-300)
        values, w = values[keep], w[:, keep]
        v = a @ w / np.sqrt(values)
    else:
        values, v = np.linalg.eigh(a @ a.T)
        values, v = values[::-1], v[:, ::-1]
    v = fix_signs(v)
    return (values / (m - 1) if normalise and m > 1 else values), v, v.T @ a


def mode_amplitudes(values: np.ndarray, vectors: np.ndarray, modes: int = 3) -> np.ndarray:
    """(modes, n): how far each residue moves along each of the first modes."""
    k = min(modes, vectors.shape[1])
    size = np.linalg.norm(vectors[:, :k].T.reshape(k, len(vectors) // 3, 3), axis=2)
    return size * np.sqrt(np.maximum(values[:k], 0))[:, None]


def kernel_components(scores: np.ndarray, components: int = 2, top: int = 5, gamma: float | None = None) -> np.ndarray:
    """Kernel principal components (m, components), Gaussian kernel on the standardised leading scores (components, m)."""
    if gamma is not None and gamma <= 0:
        raise ValueError("gamma must be positive")
    x = scores[:top].T
    s = x.std(0)
    x = (x - x.mean(0)) / np.where(s == 0, 1, s)
    g = 1 / x.shape[1] if gamma is None else gamma
    n = len(x)
    square = (x * x).sum(1)
    step = max(1, BLOCK // max(n, 1))

    def times(v):
        """The centred kernel times vectors, some of its rows at a time."""
        v = v - v.mean(0)
        out = np.concatenate([np.exp(-g * np.maximum(square[r : r + step, None] + square - 2 * x[r : r + step] @ x.T, 0)) @ v for r in range(0, n, step)])
        return out - out.mean(0)

    values, v = leading(times, n, components)
    return fix_signs(v) * np.sqrt(np.maximum(values, 0))


def leading(times, n: int, count: int, width: int = 10, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The highest eigenvalues of a symmetric matrix known by its products, and their vectors: a block Krylov space, grown until they no longer change."""
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(n, width))))[0]
    basis, image = block, times(block)
    while True:
        h = basis.T @ image
        values, w = np.linalg.eigh((h + h.T) / 2)
        values, w = values[::-1][:count], w[:, ::-1][:, :count]
        left = image @ w - basis @ w * values
        if basis.shape[1] == n or np.abs(left).max() <= tolerance * max(abs(values[0]), 1e-300):
            return values, basis @ w
        fresh = image[:, -block.shape[1] :]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        # Directions that are spent give way to random ones, so that the space grows to the whole if need be.
        fresh = fresh + 1e-12 * max(abs(values[0]), 1e-300) * np.random.default_rng(basis.shape[1]).normal(size=fresh.shape)
        block = np.linalg.qr(fresh)[0][:, : n - basis.shape[1]]
        for _ in range(2):
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        basis, image = np.concatenate([basis, block], axis=1), np.concatenate([image, times(block)], axis=1)


# ---- Gaussian network model


def kirchhoff(x: np.ndarray, cutoff: float = 7.5, gamma: float = 1.0) -> np.ndarray:
    d = distance_matrix(x)
    g = np.where((d > 0) & (d < cutoff), -gamma, 0.0)
    np.fill_diagonal(g, -g.sum(1))
    return g


def network_modes(laplacian: np.ndarray, modes: int | None = None, least: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero modes, slowest first."""
    values, v = np.linalg.eigh(laplacian)
    keep = np.flatnonzero(values > least)[:modes]
    return values[keep], fix_signs(v[:, keep]) if len(keep) else v[:, keep]


def fluctuations(values: np.ndarray, vectors: np.ndarray, kt: float = 1.0, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covariance, mean square fluctuations, correlation within -1..1). gamma scales here besides the Laplacian."""
    cov = 3 * kt / gamma * (vectors / values) @ vectors.T if len(values) else np.zeros((len(vectors), len(vectors)))
    msf = np.diag(cov).copy()
    s = np.sqrt(np.maximum(msf, 0))
    s = np.where(s == 0, 1, s)
    return cov, msf, np.clip(cov / np.outer(s, s), -1, 1)


def b_factors(msf: np.ndarray) -> np.ndarray:
    return 8 * np.pi**2 / 3 * msf
