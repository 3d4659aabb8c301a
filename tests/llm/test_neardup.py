import random

import numpy as np
import pytest

from strandline.llm import neardup_text as T
from strandline.llm import neardup_vec as V
from strandline.llm.graph import components
from tests.llm.cases import frame, rows, words


def brute(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(docs)}


def edited(text, share, seed):
    rng = random.Random(seed)
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"edit{seed}{i}"
    return " ".join(w)


def test_near_copies_match_brute_force(spark):
    docs = [(i, words(60, i)) for i in range(60)]
    for g in range(12):
        base = words(80, 1000 + g)
        docs += [(100 + 20 * g + k, edited(base, (0.0, 0.01, 0.02, 0.03, 0.05)[k % 5], k)) for k in range(20)]
    docs += [(900, "a b c d"), (901, "A B c D"), (902, "a b c d e"), (903, None), (904, " ")]
    random.Random(0).shuffle(docs)
    got = T.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_large_group(spark):
    base = words(60, 7)
    docs = [(i, edited(base, 0.015, i)) for i in range(300)] + [(1000 + i, base) for i in range(300)]
    old, T.BLOCK_ROWS = T.BLOCK_ROWS, 16
    try:
        got = T.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        T.BLOCK_ROWS = old
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs)


def test_odd_rows(spark):
    got = T.near_duplicates(frame(spark)).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[6]["n_shingles"] == 0 and by[4]["kept"] and by[5]["kept"]
    assert by[10]["kept"] and by[None]["kept"] is None
    assert T.near_duplicates(frame(spark, True)).count() == 0
    left = T.drop_near_duplicates(frame(spark))
    assert left.columns == frame(spark).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, 10, None]))


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    error = []
    for _ in range(40):
        u = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(u[:300]), np.unique(u[100:])
        s = T.super_minhash([a, b, a[:3]])
        error.append((s[0] == s[1]).mean() - 0.5)
        assert np.isfinite(s).all() and (np.sort(np.floor(s[0, s[0] < 1])) == 0).all()
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05
    one = T.super_minhash([np.array([5], np.uint64)])[0]
    assert sorted(np.floor(one)) == list(range(T.SLOTS))


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 50, 900)]
    together = T.super_minhash(sets)
    for i, s in enumerate(sets):
        assert (T.super_minhash([s])[0] == together[i]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101), (103, 102), (102, 103)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and got[103] == 102
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = components(spark.createDataFrame([(1, None), (None, 2), (5, 5), (7, 6), (7, 6)], "a long, b long")).collect()
    assert sorted((r["id"], r["component"]) for r in odd) == [(6, 6), (7, 6)]


@pytest.mark.parametrize("small", [0, 16])
def test_vectors_match_brute_force(spark, small):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 24))
    near = [x[i % 6] + rng.normal(size=24) * 0.05 for i in range(90)]
    data = [(i, v.tolist()) for i, v in enumerate([*x, *near, x[0], x[0], 2 * x[1]])]
    data += [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] + [1.0] * 23), (905, [1.0, 2.0]), (906, [2.0, 4.1]), (0, x[0].tolist())]
    old, V.BLOCK, V.SMALL = (V.BLOCK, V.SMALL), 8, small
    try:
        got = V.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    finally:
        V.BLOCK, V.SMALL = old
    assert len(got) == len(data)
    ok = [(i, np.array(v)) for i, v in data if i < 900]
    m = np.stack([v / np.linalg.norm(v) for _, v in ok])
    linked = m @ m.T >= 0.9
    n = linked.sum(1) - 1
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], r["n_links"])
    want = {i: int(k) for (i, _), k in zip(ok, n, strict=True)}
    assert {i: found[i] for i in want} == want
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] and by[i]["component_id"] == i for i in (900, 901, 902, 903, 904))
    assert by[906]["component_id"] == 905
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("d", [2, 10, 64, 256, 768])
@pytest.mark.parametrize("count", [1_000, 60_000, 5_000_000, 2_000_000_000])
def test_recall_at_the_threshold(d, count):
    rng = np.random.default_rng(0)
    n = 400 if d > 100 else 1500
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    hashes, tables = V.plan(d, count)
    a, b = V.codes(x, tables, hashes, V.PROBES), V.codes(y, tables, hashes, V.PROBES)
    hit = np.zeros(len(x), bool)
    for t in range(tables):
        at = slice(t * V.PROBES, (t + 1) * V.PROBES)
        hit |= (a[:, at, None] == b[:, None, at]).any(axis=(1, 2))
    assert hit.mean() >= 0.96 and tables <= V.MAX_TABLES
    # Few vectors that are not alike meet.
    assert (a[:-1] == b[1:]).any(1).mean() < 0.5 or d < 64


@pytest.mark.parametrize("cosine", [0.5, 0.9, 0.99, 1.0])
def test_sketches_of_similar_vectors_are_close(cosine):
    rng = np.random.default_rng(8)
    for d in (2, 64, 300):
        x, z = rng.normal(size=(2, 4000, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        apart = np.bitwise_count(V.sketches(x) ^ V.sketches(cosine * x + np.sqrt(1 - cosine**2) * z)).sum(1)
        assert apart.max() <= V.most_apart(cosine)
        if d == 300 and cosine >= 0.9:
            assert np.bitwise_count(V.sketches(x) ^ V.sketches(z)).sum(1).min() > V.most_apart(cosine)


def test_a_pair_is_fresh_in_its_first_bucket_only():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 16))
    x[30:] = x[:30] + 0.2 * rng.normal(size=(30, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = V.codes(x, 5, 2, V.PROBES)
    for i in range(30):
        for j in (i + 30, (i + 1) % 30):
            shared = sorted(set(c[i].tolist()) & set(c[j].tolist()))
            fresh = [bool(V._fresh(c[[i]], c[[j]], np.array([k]), V.PROBES)[0]) for k in shared]
            assert fresh == [True] + [False] * (len(shared) - 1) if shared else True


def test_buckets_are_told_apart_by_their_whole_number():
    # The second pair of buckets differs in its low bits alone: the pair first meets in the third.
    a = np.array([[5, 6, 7, 1 << 40, (1 << V.HASH_BITS) + 3, (1 << V.HASH_BITS) + 4, (1 << V.HASH_BITS) + 5, (1 << V.HASH_BITS) + 9]])
    b = np.array([[8, 9, 10, (1 << 40) + 1, (1 << V.HASH_BITS) + 30, (1 << V.HASH_BITS) + 40, (1 << V.HASH_BITS) + 50, (1 << V.HASH_BITS) + 9]])
    assert V._fresh(a, b, np.array([(1 << V.HASH_BITS) + 9]), 4).tolist() == [True]
    b[0, 3] -= 1
    assert V._fresh(a, b, np.array([(1 << V.HASH_BITS) + 9]), 4).tolist() == [False] and V._fresh(a, b, np.array([1 << 40]), 4).tolist() == [True]


def test_vectors_beside_clashing_columns(spark):
    names = ("class", "rep", "mult", "width", "codes", "buckets", "bucket", "n", "id", "component_id", "kept")
    rows = [(1, [1.0, 0.0], *"abcdefghijk"), (2, [1.0, 0.1], *"abcdefghijk"), (2, [0.0, 5.0], *"abcdefghijk"), (3, [0.0, 1.0], *"abcdefghijk"), (None, [1.0, 0.0], *"abcdefghijk")]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, " + ", ".join(f"`{c}` string" for c in names))).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_hadamard():
    x = np.eye(8)
    h = V.hadamard(x)
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 1 / np.sqrt(8))
    for n in (2, 16, 64, 512, 1024):
        bits = np.array([[bin(i & j).count("1") & 1 for j in range(n)] for i in range(n)])
        assert np.allclose(V.hadamard(np.eye(n)), (1 - 2 * bits) / np.sqrt(n))
