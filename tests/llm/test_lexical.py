"""Ranked search: against scores of all documents, whatever the blocks, ties and odd rows."""

from __future__ import annotations

import math
import random
import re

import pytest

from strandline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top):
    """Rows (item, rank, doc, score) by scoring every document; docs and items: (id, text)."""
    read = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    read = [(i, ts) for i, ts in read if ts]
    n, length = len(read), sum(len(ts) for _, ts in read)
    df = {}
    for _, ts in read:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, ts in read:
            m = 50 + 50 * len(ts) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * ts.count(t)) // (1000 * ts.count(t) + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in ts)
            if s > 0:
                found.append((-s, i is None, i or 0, i, s))
        out += [(item, k, f[3], f[4]) for k, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"W{k}" if k % 7 else f"ñÜ{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(60)] + [(n + 100, None), (n + 101, ""), (n + 102, " .,!"), (n + 103, "W3 " * 20_000)]
    items = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for k in range(12)] + [(50, None), (51, "unknown"), (52, docs[3][1]), (53, "W0")]
    return docs, items


@pytest.mark.parametrize("top, block, cells", [(50, 200_000, 1 << 22), (5, 200_000, 64), (50, 40, 1), (1, 30, 1 << 22), (1000, 200_000, 1 << 22)])
def test_search_equals_scores_of_all_documents(spark, monkeypatch, top, block, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    docs, items = corpus(top)
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), top, block_terms=block)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, top)


def test_uniform_threshold_reads_less_than_the_lists(spark, monkeypatch):
    """Documents below the threshold in every list never reach the sums."""
    rng = random.Random(3)
    docs = [(i, "rare word here again " * 3) for i in range(5)] + [(10 + i, "common " + " ".join(f"x{rng.randint(0, 400)}" for _ in range(200))) for i in range(300)]
    seen, plain = [], lexical._sums

    def spied(given, k):
        seen.append(given.value[3:])
        return plain(given, k)

    monkeypatch.setattr(lexical, "_sums", spied)
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "rare word here again common")], "item_id long, text string"), 3).collect()
    least, bound = seen[0]
    assert bound[0] > 0 and least[0] == -(-bound[0] // 5)
    assert sorted(map(tuple, found), key=repr) == brute(docs, [(1, "rare word here again common")], 3)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    docs = [(7, "one two", "a"), (7, "one two", "a"), (7, "one three", "b"), (None, "one four", "c"), (3, "five six", "d"), (4, "five", "d"), (5, "six six", "d"), (6, "nine", "d")]
    items = [(1, "one"), (1, "one"), (None, "five")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, term string").withColumn("key", lexical.F.lit(1)).withColumn("n", lexical.F.lit("n"))
    found = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute([d[:2] for d in docs], items, 50)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_empty_tables(spark, docs, items):
    assert lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
