import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import ensemble, grouped, kernels, pairs, relational, seqsearch, tm
from strandline.operators.pairs import contacts, pair
from tests.fixtures import POINTS, helix, hinged, points_rows, rotation, strand, wander


def test_rmsd_matches_decomposition(spark):
    models = [wander(25, k) @ rotation(k) for k in range(4)]
    models += [models[0] @ rotation(9) + 4, models[0] * [1, 1, -1]]
    p = spark.createDataFrame(points_rows(models), POINTS)
    got = ensemble.rmsd_pairs(ensemble.as_models(p)).collect()
    assert len(got) == 15
    for r in got:
        assert r["rmsd"] == pytest.approx(kernels.rmsd(models[r["m1"] - 1], models[r["m2"] - 1]), abs=1e-5)
    everything = ensemble.rmsd_pairs(ensemble.as_models(p), "all").count()
    assert everything == 36
    means = ensemble.mean_models(p)
    mean = np.mean(models, axis=0)
    for r in ensemble.rmsd_to_mean(ensemble.as_models(p), means).collect():
        assert r["rmsd"] == pytest.approx(kernels.rmsd(models[r["model"] - 1], mean), abs=1e-5)
    spread = ensemble.rmsd_summary(ensemble.rmsd_pairs(ensemble.as_models(p))).first()
    assert spread["minRMSD"] == pytest.approx(0, abs=1e-4)


def test_difference_distances(spark):
    models = hinged(4, 8)
    p = spark.createDataFrame(points_rows(models), POINTS)
    d = ensemble.residue_distances(p)
    assert d.count() == 4 * 16 * 15 // 2
    m = np.array([kernels.distance_matrix(x) for x in models])
    i, j = np.triu_indices(4, 1)
    dd = np.abs(m[i] - m[j])
    for r in ensemble.difference_aggregate(d).collect():
        assert r["rms"] == pytest.approx(np.sqrt((dd[:, r["i"] - 1, r["j"] - 1] ** 2).mean()), abs=1e-9)
        assert r["largest"] == pytest.approx(dd[:, r["i"] - 1, r["j"] - 1].max(), abs=1e-9)
    far = np.abs(np.subtract.outer(np.arange(16), np.arange(16))) >= 5
    for r in ensemble.pair_scores(ensemble.residue_distances(p, 5)).collect():
        k = next(n for n, (a, b) in enumerate(zip(i, j, strict=True)) if (a + 1, b + 1) == (r["m1"], r["m2"]))
        assert r["score"] == pytest.approx(np.sqrt((dd[k][far] ** 2).mean()), abs=1e-9)
    rigid = spark.createDataFrame(points_rows([wander(8), wander(8) @ rotation(1) + 2]), POINTS)
    assert ensemble.difference_distances(ensemble.residue_distances(rigid)).filter("dd > 1e-9").count() == 0
    rms, largest = np.sqrt((dd**2).mean(0)), dd.max(0)
    residues = p.select("chain", F.col("seq").alias("i")).distinct()
    for r in ensemble.residue_signal(ensemble.difference_aggregate(d), residues).collect():
        assert r["largest"] == pytest.approx((largest * far)[r["i"] - 1].max()) and r["rms"] == pytest.approx(np.sqrt(((rms**2) * far).mean(1))[r["i"] - 1])


def test_hinge_is_found(spark):
    p = spark.createDataFrame(points_rows(hinged()), POINTS)
    agg = ensemble.difference_aggregate(ensemble.residue_distances(p))
    labels = grouped.find_domains(agg)
    assert labels.select("k").first()["k"] == 2
    signal = ensemble.residue_signal(agg, p.select("chain", F.col("seq").alias("i")).distinct())
    top = ensemble.hinges(signal, labels.select("chain", "i", "label")).orderBy(F.desc("hinge")).first()
    assert 12 <= top["i"] <= 19


def test_contacts_and_network(spark):
    x = [np.stack([np.arange(30) * 3.8, np.zeros(30), np.zeros(30)], axis=1), wander(30, 2)]
    p = spark.createDataFrame(points_rows(x), POINTS)
    got = pairs.contacts(p, ["chain", "model"], 7.5).collect()
    for m in (1, 2):
        d = kernels.distance_matrix(x[m - 1])
        want = {(i + 1, j + 1) for i in range(30) for j in range(i + 1, 30) if 0 < d[i, j] < 7.5}
        assert {(r["i"], r["j"]) for r in got if r["model"] == m} == want
    full = ensemble.laplacian(p).filter("model = 2").collect()
    g = np.zeros((30, 30))
    for r in full:
        g[r["i"] - 1, r["j"] - 1] = r["value"]
    assert np.allclose(g, kernels.kirchhoff(x[1]))
    msf = grouped.network_model(p).filter("model = 1").orderBy("seq").toPandas()
    assert msf["msf"].iloc[0] > msf["msf"].iloc[15] and (msf["n_modes"] == 29).all()
    m = grouped.network_matrices(p).filter("model = 1").first()
    assert np.trace(np.array(m["covariance"])) == pytest.approx((3 / np.array(m["eigenvalues"])).sum())


def test_clusters_and_maps(spark):
    base, other = wander(20, 1), wander(20, 8)
    noise = lambda k: np.random.default_rng(k).normal(0, 0.05, (20, 3))
    p = spark.createDataFrame(points_rows([base, base + noise(1), other, base + noise(2), other + noise(3)]), POINTS)
    c = grouped.cluster_models(ensemble.rmsd_pairs(ensemble.as_models(p)), 2.0, "rmsd")
    assert [r["cluster"] for r in c.orderBy("model").collect()] == [1, 1, 2, 1, 2]
    maps = grouped.cluster_maps(c).first()
    assert maps["clusters"] == {1: [1, 2, 4], 2: [3, 5]} and maps["ensembles"]["ensemble2"] == ["model3", "model5"]
    tree = grouped.linkage_tree(ensemble.rmsd_pairs(ensemble.as_models(p)), value="rmsd")
    assert tree.count() == 4
    t = grouped.tm_pairs(p).collect()
    assert all((r["tm"] > 0.9) == ({r["m1"], r["m2"]} <= {1, 2, 4} or {r["m1"], r["m2"]} == {3, 5}) for r in t)
    e = grouped.essential_dynamics(p).first()
    assert e["labels"] in ([0, 0, 1, 0, 1], [1, 1, 0, 1, 0]) and e["cumulative"][-1] == pytest.approx(1)


def test_structure_search(spark):
    x = wander(40, 3)
    rows = [("a", "A" * 40, x.ravel().tolist()), ("b", "C" * 40, (x @ rotation(2) + 1).ravel().tolist()), ("c", "D" * 50, wander(50, 11).ravel().tolist()), ("d", "E" * 2, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id string, seq string, xyz array<double>")
    got = {(r["query"], r["target"]): r for r in grouped.structure_search(df, df).collect()}
    assert got["a", "b"]["tm1"] == pytest.approx(1) and got["a", "c"]["tm1"] < 0.5 and got["a", "d"]["tm1"] is None
    assert got["a", "b"]["marks"] == ":" * 40
    assert ("c", "d") not in {(r["query"], r["target"]) for r in grouped.structure_search(df, df, cut=0.5).collect()}


def test_secondary_structure(spark):
    p = spark.createDataFrame(points_rows([helix(10), strand(10)]), POINTS)
    got = p.select("model", "seq", C.secondary_structure(F.col("x"), F.col("y"), F.col("z"), ["chain", "model"], "seq").alias("ss")).orderBy("model", "seq").collect()
    assert "".join(r["ss"] for r in got) == "CCHHHHHHCC" + "CCEEEEEECC"


def test_columns(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c).first()[0]
    assert one(C.aa3_to_1(F.col("a")), a="TRP") == "W" and one(C.aa3_to_1(F.col("a"), strict=False), a="XYZ") == "X"
    with pytest.raises(Exception, match="unknown residue"):
        one(C.aa3_to_1(F.col("a")), a="XYZ")
    seq = "A" * 200
    assert [len(x) for x in one(C.fasta_wrap(F.col("a")), a=seq).split("\n")] == [80, 80, 40]
    assert [len(x) for x in one(C.fasta_wrap(F.col("a"), legacy=True), a=seq).split("\n")] == [81, 80, 39]
    assert one(C.fasta_wrap(F.col("a")), a="A" * 160).count("\n") == 1
    assert one(C.model_label(F.col("a"), F.col("b")), a="1ABC_A", b=3) == "1ABC_A_03"
    assert one(C.normal_id(F.col("a")), a=" 1abc.cif ") == "1ABC" and one(C.key_chain(F.col("a")), a="1ABC_AB") == "AB"
    assert one(C.deposition_year(F.col("a")), a="1999-01-02") == 1999
    assert one(C.tm_d0(F.lit(100)), a=1) == pytest.approx(1.24 * 85 ** (1 / 3) - 1.8)
    s = one(C.tm_d0_search(F.lit(19)), a=1)
    assert s["d0"] == pytest.approx(0.968) and s["d0_search"] == 4.5
    assert [one(C.rmsd_band(F.lit(v)), a=1) for v in (0.5, 1.5, 3.0, 6.0, 8.0, 11.0)] == ["near identical", "very similar", "similar", "related", "different", "unrelated"]
    assert one(C.tm_band(F.lit(0.6)), a=1) == "same fold" and one(C.contact_msf_to_b(F.lit(1.0)), a=1) == pytest.approx(26.3189, abs=1e-3)
    assert one(C.lookup(C.DSSP8, F.col("a")), a="E") == 2 and one(C.lookup(C.DSSP3, F.col("a"), -1), a="?") == -1


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, 1, None), (3, 20, 11.0), (4, 20, 5.0)], "id int, CA_count int, meanRMSD double")
    assert [r["id"] for r in relational.prune(df, ["CA_count < 3", "meanRMSD > 10"]).orderBy("id").collect()] == [1, 4]
    assert [r["id"] for r in relational.sort_for_report(df, "meanRMSD", "CA_count", "id").collect()] == [3, 4, 1, 2]
    one = spark.createDataFrame([("a", 1.0)], "k string, v double")
    r = relational.spread(one, ["k"], "v", "V").first()
    assert r["stdevV"] is None and r["minV"] == 1.0
    assert relational.spread(one, ["k"], "v", "V", least=2).first()["minV"] is None


def test_hits(spark):
    rows = [("a", "a", 0.0, 100.0, 50, 1.0, 1.0, 0), ("a", "b", 1e-4, 30.0, 20, 0.9, 0.9, 1), ("b", "a", 1e-4, 30.0, 20, 0.9, 0.9, 2), ("a", "c", 1e-3, 90.0, 90, 1.0, 1.0, 3), ("c", "d", None, 90.0, 90, 1.0, 1.0, 4), ("d", "a", 1e-9, 31.0, 21, 0.95, 0.95, 5)]
    h = spark.createDataFrame(rows, "query string, target string, evalue double, pident double, alnlen int, qcov double, tcov double, ordinal long")
    yes, no = relational.split_homologues(h)
    assert [r["ordinal"] for r in yes.orderBy("ordinal").collect()] == [1, 2, 5] and [r["ordinal"] for r in no.orderBy("ordinal").collect()] == [3, 4]
    assert relational.split_homologues(h, keep_self=True)[0].count() == 4
    assert [r["ordinal"] for r in relational.dedupe_pairs(relational.drop_self(h)).orderBy("ordinal").collect()] == [1, 3, 4, 5]
    n = {r["key"]: r["homologues"] for r in relational.neighbours(yes).collect()}
    assert n == {"a": ["b", "b", "d"], "b": ["a", "a"], "d": ["a"]}


def test_bins_and_density(spark):
    df = spark.createDataFrame([(float(i % 37), i) for i in range(103)], "v double, id int")
    want = np.sort([i % 37 for i in range(103)])[:100].reshape(10, 10).mean(1)
    for part in (None, F.floor(F.col("v") / 5)):
        got = relational.binned_means(df, "v", 10, order=["v", "id"], part=part).orderBy("bin").collect()
        assert [r["mean"] for r in got] == pytest.approx(want.tolist())
    d = relational.density(df, "v", points=400).orderBy("x").toPandas()
    assert np.trapezoid(d["density"], d["x"]) == pytest.approx(1, abs=0.01)
    one = relational.one_chain_each(spark.createDataFrame([("p", f"p_{i}") for i in range(9)], "pid string, pidc string"))
    assert one.count() == 1


def test_sequence_search(spark):
    a = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQ"
    b = a[:30] + "G" + a[30:60] + a[62:]
    rows = [("q", a), ("near", b), ("far", "GSHMWWPPCCGGHHNNYYTTVVIILL" * 3)]
    df = spark.createDataFrame(rows, "id string, seq string")
    got = {(r["query"], r["target"]): r for r in seqsearch.search(df, df, 6, 2).collect()}
    assert got["q", "q"]["pident"] == 100 and got["q", "q"]["qcov"] == 1.0
    r = got["q", "near"]
    assert r["evalue"] < 1e-20 and r["pident"] > 90 and r["qcov"] > 0.97 and ("q", "far") not in got
    assert got["q", "q"]["ordinal"] == 1
    score, length, same, a0, a1, b0, b1 = seqsearch.local_alignment(b"XXHEAGAWGHEEXX", b"PAWHEAE")
    assert score == brute_local("XXHEAGAWGHEEXX", "PAWHEAE") and same <= length


def brute_local(a, b):
    t, neg = seqsearch._TABLE, -(10**9)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[neg] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[neg] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i - 1][j] - 11, e[i - 1][j] - 1)
            f[i][j] = max(h[i][j - 1] - 11, f[i][j - 1] - 1)
            h[i][j] = max(0, h[i - 1][j - 1] + int(t[ord(a[i - 1]), ord(b[j - 1])]), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_shuffled_rows_give_the_same(spark):
    p = spark.createDataFrame(points_rows([wander(12, k) for k in range(5)]), POINTS)
    a = ensemble.rmsd_pairs(ensemble.as_models(p)).orderBy("m1", "m2").collect()
    b = ensemble.rmsd_pairs(ensemble.as_models(p.orderBy(F.rand(1)).repartition(7))).orderBy("m1", "m2").collect()
    assert json.dumps([round(r["rmsd"], 9) for r in a]) == json.dumps([round(r["rmsd"], 9) for r in b])


def test_word_hits_read_whole_texts(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    q = [(i, letters(60)) for i in range(3)]
    # Passages before and after character 30,000, one at the very end, and a text shorter than a word.
    t = [(10, letters(100) + q[0][1] + letters(31_000) + q[1][1] + letters(500)), (11, letters(40_000) + q[2][1][:40]), (12, "acgt"), (13, letters(200))]
    words = lambda x: {x[i : i + 24] for i in range(len(x) - 23)}
    want = {(a, b, len(words(x) & words(y))) for a, x in q for b, y in t if len(words(x) & words(y)) >= 2}
    frames = [spark.createDataFrame(rows, "id long, seq string") for rows in (q, t)]
    assert {tuple(r) for r in seqsearch.word_hits(*frames, 24, 2).select("query", "target", "shared").collect()} == want and len(want) == 3


def test_blocks_of_pairs(spark):
    rows = [(k % 3, i) for k in range(3) for i in range(17 + k)]
    df = spark.createDataFrame(rows, "g int, v int")
    for mode in ("lt", "ne", "all"):
        want = sorted((g, v, w) for g, v in rows for h, w in rows if g == h and (v < w or mode == "ne" and v != w or mode == "all"))
        for blocks in (1, 2, 5):
            got = pair(df, ["g"], "v", mode, blocks)
            assert sorted(map(tuple, got.select("g", "v_1", "v_2").collect())) == want
    whole = pair(df.select(F.monotonically_increasing_id().alias("v")), [], "v", blocks=4)
    assert whole.distinct().count() == whole.count() == len(rows) * (len(rows) - 1) // 2
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contacts_and_laplacian_by_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-3, 3, (60, 3))
    p = spark.createDataFrame(points_rows([x]), POINTS)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {(i + 1, j + 1) for i in range(60) for j in range(i + 1, 60) if d[i, j] < 1.3}
    got = contacts(p, ["chain", "model"], 1.3).collect()
    assert len(got) == len(want) and {(r["i"], r["j"]) for r in got} == want
    full = np.zeros((60, 60))
    for r in ensemble.laplacian(p, 1.3, 2.0).collect():
        full[r["i"] - 1, r["j"] - 1] += r["value"]
    assert np.allclose(full, kernels.kirchhoff(x, 1.3, 2.0))


def test_chains_of_one_model_and_uneven_ones(spark):
    p = spark.createDataFrame(points_rows(hinged()) + points_rows(hinged()[:1], "B"), POINTS)
    agg = ensemble.difference_aggregate(ensemble.residue_distances(p))
    got = {(r["chain"], r["k"], r["silhouette"] is None) for r in grouped.find_domains(agg).collect()}
    assert ("B", 1, True) in got and ("A", 2, False) in got
    every = p.select("chain", "model").distinct()
    clusters = grouped.cluster_models(ensemble.rmsd_pairs(ensemble.as_models(p)), 2.0, "rmsd", every).collect()
    assert len(clusters) == 7 and [r["cluster"] for r in clusters if r["chain"] == "B"] == [1]
    uneven = spark.createDataFrame(points_rows([wander(9, 1), wander(8, 1)], "C"), POINTS)
    rows = {r["chain"]: r for r in grouped.essential_dynamics(p.unionByName(uneven)).collect()}
    assert rows["C"]["problem"] and rows["C"]["eigenvalues"] is None and rows["A"]["problem"] is None and rows["B"]["problem"] is None


def test_average_linkage_by_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.uniform(1, 5, (9, 9))
    m = np.triu(m, 1) + np.triu(m, 1).T
    groups = [[i] for i in range(9)]
    while len(groups) > 1:
        mean = lambda a, b: np.mean([m[i, j] for i in a for j in b])
        h, a, b = min((mean(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if h > 2.9:
            break
        groups[a] += groups.pop(b)
    rows = [("X", i, j, float(m[i, j])) for i in range(9) for j in range(i + 1, 9)]
    got = grouped.cluster_models(spark.createDataFrame(rows, "chain string, m1 long, m2 long, value double"), 2.9).collect()
    found = {}
    for r in got:
        found.setdefault(r["cluster"], []).append(r["model"])
    assert sorted(map(sorted, groups)) == sorted(map(sorted, found.values())) and len(found) > 1


def test_tm_square_and_standard_residues(spark):
    models = [wander(30, 3), wander(30, 3) @ rotation(4) + 2, wander(30, 8)]
    p = spark.createDataFrame(points_rows(models), POINTS)
    got = {(r["i"], r["j"]): r["value"] for r in grouped.tm_square(p).collect()}
    assert len(got) == 9 and all(got[i, i] == 1 for i in (1, 2, 3)) and got[1, 2] == pytest.approx(1, abs=1e-6)
    assert all(got[i, j] == got[j, i] for i, j in got) and got[1, 3] < 0.6
    named = p.withColumn("mon", F.when(F.col("seq") > 25, "HOH").otherwise("GLY"))
    first = ensemble.rmsd_of_standard(named).filter("m1 = 1 AND m2 = 3").first()["rmsd"]
    assert first == pytest.approx(kernels.rmsd(models[0][:25], models[2][:25]))
    with pytest.raises(Exception, match="different standard residues"):
        ensemble.rmsd_of_standard(named.filter("model <> 2 OR seq <> 3")).collect()


def test_superposed_coordinates(spark):
    x, r = wander(12, 3), rotation(7)
    row = [(x.ravel().tolist(), r.ravel().tolist(), [1.0, 2.0, 3.0])]
    got = grouped.superposed(spark.createDataFrame(row, "xyz array<double>, rotation array<double>, shift array<double>")).first()["moved"]
    assert np.allclose(np.array(got).reshape(-1, 3), x @ r + [1, 2, 3])


def test_aligner_options():
    x = wander(60, 3)
    y = x[:40] @ rotation(5) + 4
    plain = tm.align(x, y)
    more = tm.align(x, y, average=True, length=80, d0=5.0)
    assert plain["tm1"] == more["tm1"] < more["tm_average"] < more["tm2"] and more["tm_length"] == pytest.approx(0.5, abs=0.01) and more["tm_d0"] == pytest.approx(1, abs=1e-6)
    assert tm.align(x, y, cut=0.9) is None and tm.align(y, x, cut=0.9)["tm1"] == pytest.approx(1, abs=1e-6)
    known = tm.by_number(np.arange(60), np.arange(10, 50))
    assert known.tolist() == list(range(10, 50)) and tm.by_number(np.array([1, 1, 2]), np.array([2, 1, 9])).tolist() == [2, 0, -1]
    chains = (np.array(["A", "A", "B"]), np.array(["B", "A", "A"]))
    assert tm.by_number(np.array([1, 2, 1]), np.array([1, 2, 1]), chains).tolist() == [2, 1, 0]


def test_quartiles_in_bounded_memory(spark):
    df = spark.range(2001).withColumn("k", F.lit(1))
    exact, near = relational.quartiles(df, ["k"], "id").first(), relational.quartiles(df, ["k"], "id", 1000).first()
    assert exact["median"] == 1000 and all(abs(exact[c] - near[c]) <= 3 for c in ("q1", "median", "q3"))


def test_more_hits_are_sorted_in_more_partitions(spark, monkeypatch, tmp_path):
    """What a task sorts does not grow with the table; the pairs are the same."""
    from strandline.plans import queries, tables

    lines = [(o, n, (7 * o + 3 * n) % 11, 10.0, 0.05, 0.02) for o in range(40) for n in range(1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    few = sorted(map(tuple, queries.QUERIES["pair_dedupe"](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tables, "SORTED", 10)
    assert tables.hits_parts(spark, str(tmp_path)) == 48
    many = queries.QUERIES["pair_dedupe"](spark, str(tmp_path))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 48)") == 3 and plan.count("Exchange hashpartitioning") == 3
    assert sorted(map(tuple, many.collect())) == few and few
