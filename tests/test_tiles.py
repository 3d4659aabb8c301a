"""Pairs by tiles against pairs one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import ensemble, grouped, kernels, tiles, tm
from tests.fixtures import POINTS, points_rows, wander


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 3)


def some_models():
    return {"A": [wander(12, k) for k in range(11)], "B": [wander(9, k) for k in range(4)] + [wander(8, k) for k in range(3)], "C": [wander(5, 1)]}


def frame(spark, models):
    return spark.createDataFrame([r for c, m in models.items() for r in points_rows(m, c)], POINTS)


@pytest.mark.parametrize("mode", ["lt", "ne", "all"])
def test_rmsd_by_tiles(spark, small, mode):
    models = some_models()
    got = ensemble.rmsd_pairs(ensemble.as_models(frame(spark, models)), mode)
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    keep = {"lt": lambda i, j: i < j, "ne": lambda i, j: i != j, "all": lambda i, j: True}[mode]
    want = {(c, i + 1, j + 1): kernels.rmsd(a, b) for c, m in models.items() for i, a in enumerate(m) for j, b in enumerate(m) if len(a) == len(b) and keep(i, j)}
    assert len(rows) == len(want) and all(r["rmsd"] == pytest.approx(want[r["chain"], r["m1"], r["m2"]], abs=1e-5) for r in rows)


def test_clusters_travel_as_models(spark):
    models = some_models()
    models = {"A": models["A"], "C": models["C"], "D": [wander(9, 20 + k) for k in range(7)]}
    m = ensemble.as_models(frame(spark, models))
    every = m.select("chain", "model")
    pairs = ensemble.rmsd_pairs(m)
    rows = lambda df: sorted(map(tuple, df.collect()))
    made = grouped.cluster_ensembles(m, 3.0)
    assert rows(made) == rows(grouped.cluster_models(pairs, 3.0, "rmsd", every))
    assert rows(grouped.cluster_ensembles(m, 3.0, alone=False)) == rows(grouped.cluster_models(pairs, 3.0, "rmsd"))
    # Only models are shuffled to where a chain is merged.
    assert "m1" not in made._jdf.queryExecution().executedPlan().toString()
    for method in ("average", "ward"):
        got, want = (rows(df) for df in (grouped.ensemble_tree(m, method), grouped.linkage_tree(pairs, method, "rmsd")))
        got = [r for r in got if r[0] != "C"]
        assert [r[:4] for r in got] == [r[:4] for r in want] and np.allclose([r[4] for r in got], [r[4] for r in want])
    mixed = ensemble.as_models(frame(spark, {"B": some_models()["B"] + [wander(4, 0)]}))
    found = {r["model"]: r["cluster"] for r in grouped.cluster_ensembles(mixed, 0.0).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: None}


def test_agglomeration_takes_half_a_matrix():
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(3, 3000, 4))
    x -= x.mean(2, keepdims=True)
    tracemalloc.start()
    tree = kernels.agglomerate(kernels.rmsd_condensed(x, (x**2).sum((0, 2))), 3000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree) == 2999 and peak < 3000 * 3000 * 8 * 0.85


def test_highest_scores_leave_their_tiles(spark, small):
    models = some_models()
    models["A"] += [models["A"][0], models["A"][3]]
    models["D"] = [wander(7, 2)] * 6
    d = ensemble.residue_distances(frame(spark, models), 2)
    want = ensemble.top_pairs(ensemble.pair_scores(d).withColumn("score", F.round("score", 1)), 5)
    got = ensemble.top_scores(d, 5, 1)
    rows = lambda df: sorted(map(tuple, df.select("chain", "m1", "m2", "score", "rank").collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 15


def test_totals_without_pairs(spark):
    d = ensemble.residue_distances(frame(spark, {"A": some_models()["A"] + [wander(12, 3)], "C": [wander(5, 1)]}))
    got = ensemble.difference_totals(d)
    want: dict = {}
    for r in ensemble.difference_distances(d).collect():
        n, total = want.get((r["chain"], r["i"], r["j"]), (0, 0.0))
        want[r["chain"], r["i"], r["j"]] = (n + 1, total + r["dd"])
    rows = got.collect()
    assert len(rows) == len(want) and all(r["pairs"] == want[r["chain"], r["i"], r["j"]][0] and r["total"] == pytest.approx(want[r["chain"], r["i"], r["j"]][1]) for r in rows)


def test_scores_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(grouped, "MATCHED", 3)
    monkeypatch.setattr(grouped, "ALIGNED", 3)
    models = {"A": [wander(12, k) for k in range(7)], "B": [wander(9, 0), wander(8, 1), wander(9, 2), wander(2, 0), wander(2, 1)]}
    p = frame(spark, models)
    for mode in ("lt", "ne"):
        got = {(r["chain"], r["m1"], r["m2"]): r for r in grouped.tm_pairs(p, mode).collect()}
        assert len(got) == (7 * 6 + 5 * 4) // (2 if mode == "lt" else 1)
        for (c, i, j), r in got.items():
            a, b = models[c][i - 1], models[c][j - 1]
            if min(len(a), len(b)) < 3:
                assert r["tm"] is None and r["n_ali"] is None
            elif len(a) == len(b):
                assert r["tm"] == pytest.approx(tm.tm_score(a, b), abs=1e-6) and r["rmsd"] == pytest.approx(kernels.rmsd(a, b)) and r["n_ali"] == len(a)
            else:
                assert r["tm"] == pytest.approx(tm.align(a, b)["tm1"])
    square = {(r["chain"], r["i"], r["j"]): r["value"] for r in grouped.tm_square(p, realign=False).collect()}
    assert len(square) == 49 + 25
    for (c, i, j), v in square.items():
        if i != j and v is not None:
            assert v == pytest.approx((got[c, i, j]["tm"] + got[c, j, i]["tm"]) / 2, abs=1e-6)


def test_only_chains_of_several_lengths_are_aligned(spark, monkeypatch):
    """Where all models of a chain correspond, the pass that aligns gets none of them."""
    given, tm_pairs = {}, grouped.tm_pairs
    monkeypatch.setattr(grouped, "tm_pairs", lambda points, *a, alike=None, **b: given.update({alike: points}) or tm_pairs(points, *a, alike=alike, **b))
    models = {"A": [wander(8, k) for k in range(3)], "B": [wander(8, 0), wander(7, 1)]}
    square = grouped.tm_square(frame(spark, models), realign=False)
    assert {r["chain"] for r in given[False].select("chain").distinct().collect()} == {"B"}
    assert {(r["chain"], r["i"], r["j"]) for r in square.collect()} == {(c, i + 1, j + 1) for c, m in models.items() for i in range(len(m)) for j in range(len(m))}


def test_rounding_is_sparks(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.random(2000), (rng.integers(0, 20000, 2000) + 0.5) / 1e4, np.nextafter(rng.integers(0, 20000, 500) / 1e4 + 5e-5, 1), [0.0, 1e17, -0.00005, -0.2, 2.00005, np.nan]])
    v = np.concatenate([v, np.nextafter(v, 0)])
    for digits in (3, 4, 6):
        got = kernels.rounded(v, digits)
        want = np.array([r[0] for r in spark.createDataFrame([(float(x),) for x in v], "v double").coalesce(1).select(F.round("v", digits)).collect()])
        assert np.array_equal(got, want, equal_nan=True)


def test_summary_without_pairs(spark, small):
    """Sums leave the tiles; the pairs do not."""
    models = some_models()
    models["D"] = [wander(6, 1), wander(6, 2)]
    models["E"] = [wander(6, 3), wander(6, 4) * np.nan, wander(6, 5) * np.nan]
    models["F"] = [wander(6, 3), wander(6, 4) * np.nan]
    m = ensemble.as_models(frame(spark, models))
    got = ensemble.rmsd_pairs_summary(m, digits=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "m1" not in plan
    got = {r["chain"]: tuple(r)[1:] for r in got.collect()}
    want = {r["chain"]: tuple(r)[1:] for r in ensemble.rmsd_summary(ensemble.rmsd_pairs(m), digits=2).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert all(g == pytest.approx(x) if x is not None else g is None for g, x in zip(got[c], w, strict=True)), (c, got[c], w)


@pytest.mark.parametrize("method", ["average", "ward"])
def test_agglomeration_in_bounded_memory(method, monkeypatch):
    """The tree of the half matrix, without it: memory does not grow with the square of the models."""
    import tracemalloc

    monkeypatch.setattr(kernels, "TILE", 64)
    rng = np.random.default_rng(3)
    for n, held in ((2, 1), (7, 2), (300, 40), (300, 1)):
        x = rng.normal(size=(3, n, 6)) + 2 * rng.normal(size=(3, 5, 6))[:, rng.integers(5, size=n)]
        x -= x.mean(2, keepdims=True)
        e = (x**2).sum((0, 2))
        want = kernels.agglomerate(kernels.rmsd_condensed(x, e), n, method)
        got = kernels.agglomerate_models(x, e, method, held)
        assert np.array_equal(got[:, [0, 1, 3]], want[:, [0, 1, 3]]) and np.allclose(got[:, 2], want[:, 2])
    monkeypatch.setattr(kernels, "TILE", 128)
    x = rng.normal(size=(3, 1500, 4))
    x -= x.mean(2, keepdims=True)
    tracemalloc.start()
    kernels.agglomerate_models(x, (x**2).sum((0, 2)), method, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 1500 * 8 * 0.3
