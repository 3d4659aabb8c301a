import numpy as np
import pytest

from strandline.operators import kernels as K
from strandline.operators import tm
from tests.fixtures import helix, hinged, rotation, strand, wander


def test_superposition():
    p = wander(30)
    q = p @ rotation(1) + 5
    assert K.rmsd(p, q) == pytest.approx(0, abs=1e-9)
    assert K.rmsd(p, p * [1, 1, -1]) > 0.5
    assert K.rmsd(p, q + 0.1) == pytest.approx(0, abs=1e-9) and K.rmsd(p, wander(30, 5)) == pytest.approx(K.rmsd(wander(30, 5), p))
    assert np.allclose(K.align_all(np.array([p, q]))[1], p)


def test_linkage_by_hand():
    d = np.array([[0, 1, 4, 5], [1, 0, 3, 6], [4, 3, 0, 2], [5, 6, 2, 0]], float)
    t = K.linkage(d)
    assert t.tolist() == [[0, 1, 1, 2], [2, 3, 2, 2], [4, 5, 4.5, 4]]
    assert K.cut_tree(t, 4, 2.0).tolist() == [1, 1, 2, 2] and K.cut_tree(t, 4, 5).tolist() == [1] * 4 and K.cut_tree(t, 4, 0.5).tolist() == [1, 2, 3, 4]
    x = np.array([[0.0], [1], [10], [12]])
    w = K.linkage(np.abs(x - x.T), "ward")
    # Ward: two groups of two, means 0.5 and 11.
    assert w[2, 2] == pytest.approx(np.sqrt(2 * 2 * 2 / 4) * 10.5)


def test_components():
    a = K.data_matrix(hinged())
    values, v, scores = K.principal_components(a)
    assert values.sum() == pytest.approx((a**2).sum()) and (np.diff(values) <= 1e-9).all()
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-8) and np.allclose(v @ scores, a, atol=1e-8)
    full, *_ = np.linalg.eigh(a @ a.T)
    assert np.allclose(full[::-1][: len(values)], values, atol=1e-6)
    assert K.principal_components(a, True)[0][0] == pytest.approx(values[0] / 5)
    assert K.mode_amplitudes(values, v).shape == (min(3, len(values)), 30)
    s = K.data_matrix(hinged(), True)
    assert np.allclose(s.std(1, ddof=1)[s.std(1) > 0], 1)
    k = K.kernel_components(scores)
    assert k.shape == (6, 2) and np.allclose(k.mean(0), 0, atol=1e-9)
    with pytest.raises(ValueError):
        K.kernel_components(scores, gamma=-1)


def test_network():
    x = np.stack([np.arange(10) * 3.8, np.zeros(10), np.zeros(10)], axis=1)
    g = K.kirchhoff(x, 5.0)
    assert np.allclose(g.sum(1), 0) and g[0, 0] == 1 and g[4, 4] == 2
    values, v = K.network_modes(g)
    assert len(values) == 9 and (np.diff(values) > 0).all()
    cov, msf, corr = K.fluctuations(values, v)
    assert np.trace(cov) == pytest.approx((3 / values).sum()) and msf[0] > msf[5] and np.abs(corr).max() <= 1
    assert K.b_factors(msf)[0] == pytest.approx(8 * np.pi**2 / 3 * msf[0])
    broken = np.concatenate((x, x + [0, 100, 0]))
    assert len(K.network_modes(K.kirchhoff(broken, 5.0))[0]) == 18
    assert len(K.network_modes(g, 3)[0]) == 3
    assert K.kirchhoff(np.zeros((2, 3)))[0, 1] == 0


def test_domains_of_a_hinge():
    m = hinged()
    d = np.array([K.distance_matrix(x) for x in m])
    i, j = np.triu_indices(6, 1)
    dd = np.abs(d[i] - d[j])
    label, k, s = K.domains(np.sqrt((dd**2).mean(0)), dd.max(0))
    assert k == 2 and s > 0.3
    assert (label[:13] == label[0]).all() and (label[18:] == label[29]).all() and label[0] != label[29]
    with pytest.raises(ValueError):
        K.domains(np.ones((4, 4)), np.zeros((4, 4)))


def test_kmeans_and_silhouette():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 1, (20, 2)), rng.normal(9, 1, (20, 2))))
    label = K.kmeans(x, 2)
    assert label.tolist() == [0] * 20 + [1] * 20 and K.silhouette(x, label) > 0.7
    assert K.silhouette(x, np.zeros(40, int)) is None
    assert K.silhouette(np.array([[0.0], [1.0], [5.0]]), np.array([0, 0, 1])) == pytest.approx((1 - 1 / 5 + 1 - 1 / 4 + 0) / 3)
    a = np.kron(np.eye(3), np.ones((4, 4))) + 0.01
    assert K.spectral(a, 3).tolist() == [0] * 4 + [1] * 4 + [2] * 4


def test_tm_of_given_pairs():
    p = wander(60)
    assert tm.tm_score(p, p @ rotation(2) + 3) == pytest.approx(1)
    q = p.copy()
    q[30:] = (q[30:] - q[30]) @ rotation(3) + q[30]
    s = tm.tm_score(p, q)
    assert 0.5 <= s < 1
    assert tm.tm_score(p, wander(60, 9)) < 0.5
    assert tm.d0_of(21) == 0.5 and tm.d0_of(100) == pytest.approx(1.24 * 85 ** (1 / 3) - 1.8)


def test_best_path_is_optimal():
    rng = np.random.default_rng(1)
    for gap in (0.0, -0.6, -1.0):
        for _ in range(20):
            s = rng.random((5, 6))

            def value(path, s=s, gap=gap):
                total, i, j = 0.0, -1, -1
                for b, a in enumerate(path.tolist()):
                    if a >= 0:
                        total += s[a, b] + (gap if a > i + 1 and i >= 0 else 0) + (gap if b > j + 1 and j >= 0 else 0)
                        i, j = a, b
                return total

            from itertools import combinations

            best = 0.0
            for n in range(1, 6):
                for a in combinations(range(5), n):
                    for b in combinations(range(6), n):
                        path = np.full(6, -1)
                        path[list(b)] = a
                        best = max(best, value(path))
            got = tm.best_path(s, gap)
            assert (np.diff(got[got >= 0]) > 0).all()
            # The end gap of one side may cost an opening.
            assert value(got) >= best + 2 * gap - 1e-9


def test_alignment_finds_a_moved_part():
    x = np.concatenate((wander(70, 4), wander(20, 5) + 60))
    y = np.concatenate((wander(15, 6) - 50, (x[10:70] @ rotation(7)) + 9))
    out = tm.align(x, y)
    i, j = out["pairs"]
    assert (np.abs((i - 10) - (j - 15)) == 0).mean() > 0.9 and out["n_ali"] >= 55
    assert out["tm2"] > 0.75 and out["rmsd"] < 1.5
    assert tm.align(x, x)["tm1"] == pytest.approx(1)
    assert tm.align(x, x * [1, 1, -1], mirror=True)["tm1"] == pytest.approx(1)
    seq = "A" * len(x), "C" * len(y)
    top, marks, bottom = tm.alignment_strings(*seq, i, j, np.zeros(len(i)))
    assert len(top) == len(marks) == len(bottom) and top.replace("-", "") == seq[0] and bottom.replace("-", "") == seq[1] and marks.count(":") == len(i)


def test_circular():
    x = np.concatenate((helix(20), strand(20) + [0, 30, 0], helix(15)[:, ::-1] + [40, 0, 0]))
    y = np.concatenate((x[30:], x[:30])) @ rotation(4)
    assert tm.align(x, y, circular=True)["tm1"] > tm.align(x, y)["tm1"] - 1e-9


def test_secondary_structure():
    assert set(tm.secondary(helix(12))[2:-2]) == {"H"} and set(tm.secondary(strand(12))[2:-2]) == {"E"}
    assert tm.secondary(helix(12))[0] == "C" and set(tm.secondary(helix(4))) == {"C"}


def test_models_against_each_other_in_bounded_memory():
    import tracemalloc

    from strandline.operators.kernels import fix_signs, kernel_components, silhouette

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(2500, 6)), rng.normal(3, 1, size=(1500, 6))])
    labels = np.repeat([0, 1], [2500, 1500])
    tracemalloc.start()
    silhouette(x, labels)
    got = kernel_components(x.T, 2, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 4000 * 8 and got.shape == (4000, 2)
    few = x[::20]
    d = np.sqrt(((few[:, None] - few[None]) ** 2).sum(-1))
    kind = labels[::20]
    own, other = (np.array([d[i, (kind == k) & (np.arange(len(few)) != i)].mean() for i, k in enumerate(ks)]) for ks in (kind, 1 - kind))
    assert np.isclose(silhouette(few, kind), ((other - own) / np.maximum(own, other)).mean())
    for rows in (few, few[:4], np.ones((5, 6))):
        z = rows[:, :5]
        z = (z - z.mean(0)) / np.where(z.std(0) == 0, 1, z.std(0))
        k = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / 5)
        k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
        values, v = np.linalg.eigh(k)
        want = fix_signs(v[:, ::-1][:, :2]) * np.sqrt(np.maximum(values[::-1][:2], 0))
        assert np.allclose(np.abs(kernel_components(rows.T, 2, 5)), np.abs(want), atol=1e-6)


def test_many_pairs_at_once_score_as_one_by_one():
    rng = np.random.default_rng(4)
    for n in (3, 4, 9, 21, 70):
        x = np.array([wander(n, k) for k in range(150 if n == 21 else 12)])
        y = np.array([(a + rng.normal(0, [0, 0.5, 3, 9][k % 4], a.shape)) @ rotation(k) + k for k, a in enumerate(x)])
        y[3] = y[3] * [1, 1, -1]
        x[4], y[4] = x[4] * [1, 1, 0], y[4] * [1, 1, 0]
        x[5] = y[5] = np.arange(n)[:, None] * np.array([1.0, 2.0, 3.0])
        x[6] = y[6] = 1.0
        score, rmsd = tm.tm_scores(x, y)
        assert np.allclose(score, [tm.tm_score(a, b) for a, b in zip(x, y, strict=True)], atol=1e-6)
        assert np.allclose(rmsd, [K.rmsd(a, b) for a, b in zip(x, y, strict=True)], atol=1e-6)
        again, _ = tm.tm_scores(y, x)
        assert np.allclose(again, score, atol=1e-5)


def test_alignments_under_way_at_once_are_those_of_one_by_one(monkeypatch):
    """Equal bit by bit, whatever is aligned beside; and a table of searches is not one call a pair."""
    xs = [wander(n, n) for n in (3, 7, 21, 21, 22, 40, 61)] + [helix(21), strand(19)]
    pairs = [(a, b) for a in xs for b in xs]
    calls = []
    searches = tm._searches
    monkeypatch.setattr(tm, "_searches", lambda asked: calls.append(len(asked)) or searches(asked))
    many = tm.align_many(pairs)
    assert len(calls) < sum(calls) / 10
    for (x, y), r in zip(pairs, many, strict=True):
        one = tm.align(x, y)
        assert all(np.array_equal(r[k], one[k]) for k in ("tm1", "tm2", "rmsd", "n_ali", "rotation", "shift")) and all(map(np.array_equal, r["pairs"], one["pairs"]))
    for n in (3, 5, 21, 50):
        x, y = wander(n, 1), wander(n, 2)
        (got, *_), (want, *_) = tm._searches([(x, y, 2.0, n, 5.0, 8.0, 2)])[0], tm.search(x, y, 2.0, n, 5.0, 8.0, 2)
        assert abs(got - want) < 1e-9
    bad = wander(21, 3)
    bad[4] = np.nan
    assert [r is None for r in tm.align_many([(bad, xs[2]), (xs[2], xs[3]), (xs[2][:2], xs[3])])] == [True, False, True]


def test_an_alignment_searches_no_path_twice(monkeypatch):
    searches, asked = tm._searches, []
    monkeypatch.setattr(tm, "_searches", lambda asks: asked.extend(asks) or searches(asks))
    for k in range(4):
        asked.clear()
        tm.align(wander(21, k), wander(21, k + 9))
        keys = [(x.tobytes(), y.tobytes(), *rest) for x, y, *rest in asked]
        assert len(keys) == len(set(keys))


def test_memory_of_a_search_is_bounded():
    """Fragments of many pairs go together, but not all of them."""
    import tracemalloc

    x, y = (np.array([wander(100, k + s) for k in range(128)]) for s in (0, 500))
    tm.tm_scores(x[:1], y[:1])
    tracemalloc.start()
    tm.tm_scores(x, y, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
