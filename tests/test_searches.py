"""Independent sets, similar words and banded alignment against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import graphs, relational, seqsearch


def in_turn(keys, pairs, rank):
    """Kept keys and partners by going through the keys one by one."""
    near = {k: set() for k in keys}
    for a, b in pairs:
        if a in near and b in near and a != b:
            near[a].add(b)
            near[b].add(a)
    order = sorted(keys, key=rank)
    kept: list = []
    for k in order:
        if not near[k] & set(kept):
            kept.append(k)
    return {k: (k in kept, None if k in kept else next(x for x in kept if x in near[k])) for k in keys}


@pytest.mark.parametrize("n, m", [(30, 0), (40, 60), (60, 400), (25, 25)])
def test_independent_set_is_that_of_going_through_in_turn(spark, n, m):
    rng = random.Random(n + m)
    keys = [f"K{i}" for i in range(n)]
    size = {k: rng.randint(1, 4) for k in keys}
    pairs = [(rng.choice(keys), rng.choice([*keys, "other", None])) for _ in range(m)] if m != 25 else [(keys[i], keys[(i + 1) % n]) for i in range(n)]
    pairs += pairs[:5]
    nodes = spark.createDataFrame([(k, size[k]) for k in keys] + [(None, 3)], "pidc string, size int")
    links = spark.createDataFrame(pairs or [(None, None)], "query string, target string")
    got = {r["pidc"]: (r["kept"], r["partner"]) for r in graphs.independent(nodes, links, "pidc", [F.desc("size")]).collect()}
    assert got == in_turn(keys, pairs, lambda k: (-size[k], hashlib.md5(f"0:{k}".encode()).hexdigest(), k))


def test_independent_set_of_a_hub_and_of_nothing(spark):
    nodes = spark.createDataFrame([(i,) for i in range(400)] + [(7,)] * 3, "key long")
    hub = spark.createDataFrame([(0, i) for i in range(1, 400)], "query long, target long")
    got = graphs.independent(nodes, hub, prefer=[F.asc("key")]).collect()
    assert len(got) == 400 and [r["key"] for r in got if r["kept"]] == [0] and {r["partner"] for r in got if not r["kept"]} == {0}
    assert graphs.independent(nodes.limit(0), hub).count() == 0
    assert graphs.independent(nodes, hub.limit(0)).filter("kept").count() == 400


def test_related_chains_are_dropped(spark):
    stats = spark.createDataFrame([("A", 9), ("B", 5), ("C", 7), ("D", 1), (None, 0)], "pidc string, model_count int")
    good, bad = (1e-9, 90.0, 100, 1.0, 1.0), (1.0, 90.0, 100, 1.0, 1.0)
    hits = spark.createDataFrame([("A", "B", *good), ("B", "C", *good), ("C", "A", *bad), ("D", "D", *good), ("D", "A", None, 90.0, 100, 1.0, 1.0)], "query string, target string, evalue double, pident double, alnlen int, qcov double, tcov double")
    hits = hits.withColumns({"meanRMSD": F.lit(None).cast("double"), "meanTMS": F.lit(None).cast("double")})
    left = graphs.drop_related(stats, hits, "homologous", prefer=[F.desc("model_count")])
    assert {r["pidc"] for r in left.collect()} == {"A", "C", "D", None}
    kept = left.select("pidc")
    pairs = relational.pairs_by_rule(hits, "homologous").filter("query <> target")
    assert pairs.join(kept.withColumnRenamed("pidc", "query"), "query").join(kept.withColumnRenamed("pidc", "target"), "target").count() == 0


def test_similar_words_by_trying_all():
    halves = seqsearch._word_scores(1), seqsearch._word_scores(2)
    letters = seqsearch.RESIDUES
    score = lambda a, b: sum(int(seqsearch._TABLE[ord(x), ord(y)]) for x, y in zip(a, b, strict=True))
    every = [a + b + c for a in letters for b in letters for c in letters]
    for w in ("WWW", "AAA", "MKV", "CPG"):
        for t in (0, 9, 12, 40):
            assert seqsearch.neighbours_of(w, t, halves) == sorted({x for x in every if score(w, x) >= t} | {w})
    assert seqsearch.neighbours_of("AXA", 0, halves) == ["AXA"]


def evolved(rng, seq, changes):
    s = list(seq)
    for _ in range(changes):
        i, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.9:
            s[i] = rng.choice(seqsearch.RESIDUES)
        elif kind < 0.95:
            del s[i : i + rng.randint(1, 3)]
        else:
            s[i:i] = rng.choices(seqsearch.RESIDUES, k=rng.randint(1, 3))
    return "".join(s)


def test_banded_alignment_is_the_whole_one_within_its_band():
    rng = random.Random(2)
    pairs = []
    for _ in range(120):
        a = "".join(rng.choices("ARNDCQW", k=rng.randint(0, 60)))
        b = evolved(rng, a, rng.randint(0, 12)) if a else "ARN"
        lo = rng.randint(-12, 5)
        pairs.append((a.encode(), b.encode(), lo, lo + rng.randint(0, 20)))
    for p, r in zip(pairs, seqsearch.banded_alignments(pairs), strict=True):
        whole = seqsearch.local_alignment(p[0], p[1], (p[2], p[3]))
        assert r == whole or r[0] == whole[0] == 0
        assert seqsearch.local_alignment(p[0], p[1], (-99, 99)) == seqsearch.local_alignment(p[0], p[1])


def test_long_alignment_in_little_memory():
    import tracemalloc

    rng = random.Random(4)
    a = "".join(rng.choices(seqsearch.RESIDUES, k=30_000)).encode()
    tracemalloc.start()
    score, length, same, a0, a1, b0, b1 = seqsearch.banded_alignments([(a, a[:9000] + a[9020:], -40, 20)])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (length, same, a0, a1, b0, b1) == (30_000, 29_980, 0, 30_000, 0, 29_980) and peak < 200e6


def test_sensitive_search_finds_what_full_alignment_finds(spark):
    """Recall against aligning every pair in full, over relatives of 25 to 100 % identity; shared words of six find fewer."""
    rng = random.Random(8)
    rows = []
    for f in range(8):
        founder = "".join(rng.choices(seqsearch.RESIDUES, k=rng.randint(120, 200)))
        rows += [(f"{f}_{k}", evolved(rng, founder, int(len(founder) * share))) for k, share in enumerate((0.0, 0.4, 0.7, 0.9))]
    df = spark.createDataFrame(rows, "id string, seq string")
    total = sum(len(s) for _, s in rows)
    want = set()
    for q, a in rows:
        for t, b in rows:
            r = seqsearch.local_alignment(a.encode(), b.encode())
            if seqsearch.KAPPA * len(a) * total * 2.718281828459045 ** (-seqsearch.LAMBDA * r[0]) <= 1e-3:
                want.add((q, t))
    found = {(r["query"], r["target"]): r for r in seqsearch.sensitive_search(df, df).collect()}
    recall = len(want & set(found)) / len(want)
    plain = {(r["query"], r["target"]) for r in seqsearch.search(df, df, 6, 2).collect()}
    assert recall >= 0.9 and len(want & plain) / len(want) < recall and set(found) <= want
    assert all(found[q, q]["pident"] == 100 and found[q, q]["qcov"] == 1 for q, _ in rows)
    assert seqsearch.sensitive_search(df.limit(0), df).count() == 0


def brute_diagonals(queries, targets, k, threshold, window):
    halves, out = (seqsearch._word_scores(k // 2), seqsearch._word_scores(k - k // 2)), {}
    for q, a in queries:
        for t, b in targets:
            met: dict = {}
            for i in range(len(a) - k + 1):
                like = set(seqsearch.neighbours_of(a[i : i + k], threshold, halves))
                for j in range(len(b) - k + 1):
                    if b[j : j + k] in like:
                        met.setdefault(j - i, set()).add(i)
            for d, places in met.items():
                n = sum(any(k <= p - o <= window for o in places) for p in places)
                if n:
                    out[q, t, d] = n
    return out


@pytest.mark.parametrize("hits, places, index", [(1 << 20, 1 << 16, 1 << 23), (40, 1 << 16, 1 << 23), (1 << 20, 25, 500)])
def test_diagonals_by_trying_all_without_a_shuffle_of_hits(spark, monkeypatch, hits, places, index):
    rng = random.Random(11)
    founder = "".join(rng.choices(seqsearch.RESIDUES, k=90))
    queries = [(f"q{i}", evolved(rng, founder, 20)) for i in range(4)] + [("short", "ARN"), ("none", None), ("other", "XXXXJJJJXXXXZ\U0001f600ZZZ")]
    targets = [(i, evolved(rng, founder, 30) * (1 + i % 3)) for i in range(5)] + [(7, None), (8, "XXXXJJJJXXXXZ\U0001f600ZZZ"), (9, "")]
    for name, value in (("HITS", hits), ("PLACES", places), ("INDEX", index)):
        monkeypatch.setattr(seqsearch, name, value)
    found = seqsearch.diagonal_hits(spark.createDataFrame(queries, "id string, seq string"), spark.createDataFrame(targets, "id int, seq string"), 3, 12, 30)
    full = lambda rows: [(i, s) for i, s in rows if s]
    assert {(r["query"], r["target"], r["diagonal"]): r["hits"] for r in found.collect()} == brute_diagonals(full(queries), full(targets), 3, 12, 30)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_similar_words_come_in_batches_of_bounded_size(spark):
    df = spark.createDataFrame([(1, "AAAASSSSTTTT" * 20)], "id int, seq string")
    sizes = df.transform(lambda d: seqsearch.scored_words(d, 5, 9)).selectExpr("id", "length(word) AS n").groupBy("n").count().collect()
    assert sizes[0]["n"] == 5 and sizes[0]["count"] > 1 << 17


@pytest.mark.parametrize("letters", [1 << 24, 300])
def test_copies_are_searched_once_and_get_all_their_rows(spark, monkeypatch, letters):
    """Ten copies of each of three relatives: a search of three sequences, and the rows of thirty."""
    rng = random.Random(5)
    founder = "".join(rng.choices(seqsearch.RESIDUES, k=120))
    texts = [founder, evolved(rng, founder, 30), evolved(rng, founder, 40), "".join(rng.choices(seqsearch.RESIDUES, k=90))]
    some = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id long, seq string")
    many = spark.createDataFrame([(i + 100 * n, s) for n in range(10) for i, s in enumerate(texts)] + [(None, founder), (7, None), (8, "")], "id long, seq string")
    seen, whole = [], seqsearch.diagonal_hits
    monkeypatch.setattr(seqsearch, "diagonal_hits", lambda q, t, *a: seen.append((q.count(), t.count())) or whole(q, t, *a))
    monkeypatch.setattr(seqsearch, "LETTERS", letters, raising=False)
    columns = ["alnlen", "pident", "qcov", "tcov"]
    # A limit on scores that both totals pass alike.
    want = {(r["query"], r["target"]): [r[c] for c in columns] for r in seqsearch.sensitive_search(some, some, max_evalue=1e9).collect()}
    both = [seqsearch.sensitive_search(q, t, max_evalue=1e9).collect() for q, t in ((many, many), (some, many), (many, some))]
    assert seen == [(4, 4), (5, 5), (4, 5), (5, 4)] and len(want) >= 10
    for rows, times in zip(both, (100, 10, 10), strict=True):
        assert len(rows) == times * len(want) == len({(r["query"], r["target"]) for r in rows})
        assert all([r[c] for c in columns] == want[r["query"] % 100, r["target"] % 100] for r in rows)
        for q in {r["query"] for r in rows}:
            mine = sorted((r["evalue"], r["target"], r["ordinal"]) for r in rows if r["query"] == q)
            assert [o for _, _, o in mine] == list(range(1, len(mine) + 1))


def test_similar_words_that_no_target_has_do_not_leave_their_task(spark):
    import numpy as np

    rng = random.Random(6)
    targets = ["".join(rng.choices(seqsearch.RESIDUES, k=80)) for _ in range(5)] + ["XXXJ", ""]
    own = sorted({t[i : i + 3] for t in targets[:2] for i in range(78)} | {"XXX", "ZZZ"})
    words = spark.createDataFrame([(int(seqsearch.word_codes(w, 3)[0]), w) for w in own], "own long, word string")
    there = np.unique(np.concatenate([seqsearch.word_codes(t, 3) for t in targets]))
    halves = seqsearch._word_scores(1), seqsearch._word_scores(2)
    code = lambda w: int(seqsearch.word_codes(w, 3)[0])
    every = {(code(w), code(x)) for w in own for x in seqsearch.neighbours_of(w, 12, halves)}
    pairs = lambda df: {(r["own"], r["code"]) for r in df.collect()}
    assert pairs(seqsearch._similar_codes(words, 3, 12)) == every
    assert pairs(seqsearch._similar_codes(words, 3, 12, spark.sparkContext.broadcast(there))) == {(w, x) for w, x in every if x in set(there.tolist())}
    assert not pairs(seqsearch._similar_codes(words, 3, 12, spark.sparkContext.broadcast(there[:0])))


@pytest.mark.parametrize("known", [0, 1 << 22])
def test_few_and_many_words_of_targets_give_the_same_diagonals(spark, monkeypatch, known):
    rng = random.Random(12)
    founder = "".join(rng.choices(seqsearch.RESIDUES, k=70))
    queries = [(i, evolved(rng, founder, 10)) for i in range(3)] + [(9, "XXXXJJJJ")]
    targets = [(i, evolved(rng, founder, 20)) for i in range(4)] + [(8, "XXXXJJJJ")]
    monkeypatch.setattr(seqsearch, "KNOWN", known)
    found = seqsearch.diagonal_hits(spark.createDataFrame(queries, "id int, seq string"), spark.createDataFrame(targets, "id int, seq string"), 3, 12, 30)
    assert {(r["query"], r["target"], r["diagonal"]): r["hits"] for r in found.collect()} == brute_diagonals(queries, targets, 3, 12, 30)


def test_diagonals_of_a_query_and_a_target_without_an_id(spark):
    text = "".join(random.Random(3).choices(seqsearch.RESIDUES, k=40))
    rows = spark.createDataFrame([(None, text), (1, text)], "id long, seq string")
    found = {(r["query"], r["target"]): r["hits"] for r in seqsearch.diagonal_hits(rows, rows, 3, 30).filter("diagonal = 0").collect()}
    assert set(found) == {(a, b) for a in (None, 1) for b in (None, 1)} and len(set(found.values())) == 1


def test_a_hit_is_one_number():
    """A target's hits are opened in one step: memory for each is a few numbers at most, and the diagonals are those of counting."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    k, window = 5, 40
    at, own = np.arange(3000, dtype=np.int32) % 150, rng.integers(0, 12, 3000)
    postings = pa.table({"query": pa.array(np.arange(3000) // 150), "at": pa.array(at), "own": pa.array(own)})
    near = pa.table({"own": pa.array(np.repeat(np.arange(12), 2)), "code": pa.array(np.stack([np.arange(12), np.arange(12) + 12], axis=1).ravel())})
    index = seqsearch._index(near, postings, window)
    codes = rng.integers(0, 40, 300)
    want: dict = {}
    for q in range(20):
        words = own[q * 150 : q * 150 + 150]
        for d in range(-149, 300):
            on = [p for p in range(300) if 0 <= p - d < 150 and codes[p] < 24 and codes[p] % 12 == words[p - d]]
            n = sum(any(k <= p - o <= window for o in on) for p in on)
            if n:
                want[q, d] = n
    got = {(int(index["names"][int(q)].as_py()), int(d)): int(n) for q, d, n in zip(*seqsearch.diagonals_of(codes, index, k, window), strict=True)}
    assert got == want and want
    many = rng.integers(0, 24, 4000)
    tracemalloc.start()
    seqsearch.diagonals_of(many, index, k, window)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < seqsearch.HITS * 60
