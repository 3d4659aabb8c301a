"""Sparse network models against the dense ones."""

import numpy as np
import pytest

from strandline.operators import grouped, kernels, networks
from tests.fixtures import POINTS, points_rows, wander


def graph_of(x, cutoff):
    d = kernels.distance_matrix(x)
    i, j = np.nonzero(np.triu((d > 0) & (d < cutoff)))
    return networks.Graph(len(x), i, j)


@pytest.mark.parametrize("n, cutoff", [(300, 7.5), (120, 5.0), (40, 3.0), (1, 7.5)])
def test_sparse_is_dense(n, cutoff):
    x = wander(n, 4)
    g, dense = graph_of(x, cutoff), kernels.kirchhoff(x, cutoff, 1.0)
    b = np.random.default_rng(1).normal(size=(n, 3))
    assert np.allclose(g.times(b), dense @ b)
    inverse = np.linalg.pinv(dense, rcond=1e-9, hermitian=True)
    assert np.allclose(g.diagonal(np.arange(n)), np.diag(inverse), atol=1e-6 * max(1.0, inverse.max()))
    values, vectors = kernels.network_modes(dense, None)
    some, shapes = g.slow_modes(12)
    k = min(12, len(values))
    assert len(some) == k and np.allclose(some, values[:k], rtol=1e-5)
    assert np.allclose(dense @ shapes, shapes * some, atol=1e-4) and np.allclose(shapes.T @ shapes, np.eye(k), atol=1e-8)


def test_equal_values_are_all_found():
    # Two equal parts: every value comes twice.
    i = np.array([0, 1, 2, 4, 5, 6])
    g = networks.Graph(8, i, i + 1)
    assert g.part.tolist() == [0] * 4 + [1] * 4
    assert np.allclose(g.slow_modes(6)[0], np.repeat(2 - 2 * np.cos(np.pi * np.arange(1, 4) / 4), 2))


def test_large_structure_in_bounded_memory():
    import tracemalloc

    # A lattice: nothing of its square is made. (With 50,000 residues, 50 x 40 x 25, it takes some hundred MB.)
    size = (25, 20, 15)
    n = size[0] * size[1] * size[2]
    at = np.stack(np.unravel_index(np.arange(n), size), axis=1)
    pairs = [(np.flatnonzero(at[:, a] < s - 1), step) for a, (s, step) in enumerate(zip(size, (size[1] * size[2], size[2], 1), strict=True))]
    tracemalloc.start()
    g = networks.Graph(n, np.concatenate([p for p, _ in pairs]), np.concatenate([p + s for p, s in pairs]))
    values, _ = g.slow_modes(3)
    few = g.diagonal(np.array([0, n // 2]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    axis = lambda s, k: 2 - 2 * np.cos(np.pi * k / s)
    assert np.allclose(values, sorted([axis(25, 1), axis(20, 1), axis(15, 1), axis(25, 2), axis(25, 1) + axis(20, 1)])[:3], rtol=1e-5)
    assert peak < 150e6 < 8 * n * n and few[0] > few[1] > 0


def test_frames(spark):
    models = [wander(30, 1), wander(30, 2), wander(7, 3) * 9]
    p = spark.createDataFrame(points_rows(models), POINTS)
    want = {(r["model"], r["seq"]): (r["msf"], r["b_factor"]) for r in grouped.network_model(p).collect()}
    for block in (64, 8):
        got = {(r["model"], r["seq"]): (r["msf"], r["b_factor"]) for r in networks.large_fluctuations(p, block=block).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    scaled = {(r["model"], r["seq"]): r["msf"] for r in grouped.network_model(p, gamma=2.0, kt=3.0).collect()}
    assert all(np.isclose(r["msf"], scaled[r["model"], r["seq"]], atol=1e-6) for r in networks.large_fluctuations(p, gamma=2.0, kt=3.0).collect())
    modes = networks.slow_modes(p, 4).filter("model = 1").orderBy("mode").collect()
    values, vectors = kernels.network_modes(kernels.kirchhoff(models[0], 7.5, 1.0), 4)
    assert [r["mode"] for r in modes] == [1, 2, 3, 4] and np.allclose([r["eigenvalue"] for r in modes], values, rtol=1e-5)
    assert all(np.allclose(np.abs(r["shape"]), np.abs(vectors[:, k]), atol=1e-4) for k, r in enumerate(modes))
    assert networks.large_fluctuations(p.limit(0)).count() == 0
