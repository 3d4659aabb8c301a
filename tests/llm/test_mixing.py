import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing as M
from tests.llm.cases import frame, rows


def targets(sizes):
    """Shares by weight, stopping at twice the size, step by step."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not full:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def check(got, original, block):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, source in original:
        sizes[source] += size(t)
    want, taken = targets(dict(sizes)), defaultdict(int)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), size(t)) for i, t, _ in original)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mix_of_odd_rows(spark):
    got = M.mix_sources(frame(spark), block_words=16).collect()
    check(got, [(r[0], r[1], r[3]) for r in rows()], 16)
    again = M.mix_sources(frame(spark).repartition(7), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_hot_and_tiny_sources(spark):
    data = [(i, "w " * (i % 13), "hot" if i % 3 else f"s{i % 50}") for i in range(3000)]
    got = M.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string"), block_words=32).collect()
    check(got, data, 32)


def test_empty(spark):
    assert M.mix_sources(frame(spark, True)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in M.mix_sources(blank).collect()] == [(0, 0, 0.0)] * 2


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("0a", 1000, 800.0, 1600.0), ("0b", 1000, 800.0, 1600.0)], "skey string, source_size long, target double, goal double")
    slots = sorted(M.schedule(t, 100, 16).collect(), key=lambda r: r["slot"])
    for n in range(10, len(slots), 10):
        a = sum(r["skey"] == "0a" for r in slots[:n])
        assert abs(a - n / 2) <= 2


def test_stream_is_the_mix(spark):
    data = [(i, " ".join(f"w{i}_{k}" for k in range(i % 37)), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    stream = sorted(M.interleave_sources(docs, block_words=32).collect(), key=lambda r: (r["slot"], r["at"]))
    by, taken, slots = {i: (t.split(), s) for i, t, s in data}, defaultdict(int), defaultdict(list)
    for r in stream:
        assert 0 <= r["word_from"] < r["word_to"] <= len(by[r["doc_id"]][0]) and r["source"] == by[r["doc_id"]][1]
        taken[r["doc_id"]] += r["word_to"] - r["word_from"]
        slots[r["slot"]].append(r)
    assert {r["doc_id"]: r["taken"] for r in M.mix_sources(docs, block_words=32).collect()} == {i: taken[i] for i in by}
    # A slot reads one block of one source from its start, without gaps.
    words = defaultdict(int)
    total = sum(taken.values())
    share = {s: sum(taken[i] for i in by if by[i][1] == s) / total for s in {d[2] for d in data}}
    for n, slot in enumerate(sorted(slots)):
        at = 0
        for r in slots[slot]:
            assert r["at"] == at and r["source"] == slots[slot][0]["source"]
            at += r["word_to"] - r["word_from"]
        assert at <= 32
        words[slots[slot][0]["source"]] += at
        if n % 20 == 19:
            assert all(abs(words[s] - share[s] * sum(words.values())) <= 32 * 5 for s in share)


def test_documents_follow_the_mix(spark):
    data = [(i, "w " * 10, f"s{i % 3}", i) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in M.mix_sources(docs).collect()}
    count = defaultdict(int)
    for r in out.collect():
        count[r["doc_id"]] += 1
    assert all(count[i] == int(taken[i] / 10 + 0.5) for i in taken)
    assert M.mixed_documents(frame(spark)).columns == frame(spark).columns


def emitted(df):
    """Words of the rows by source."""
    out = {}
    for r in df.collect():
        out[r["source"]] = out.get(r["source"], 0) + len(r["text"].split())
    return out


@pytest.mark.parametrize("n, words", [(40, 250), (7, 1000), (3, 10)])
def test_repeated_rows_are_emitted_as_often_as_they_are_read(spark, n, words):
    for i in (5, None):
        rows = [(i, "w " * words, "a", k) for k in range(n)] + [(100 + k, "v " * words, "b", k) for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k long").repartition(3)
        taken = {r["source"]: r["t"] for r in M.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
        for source, t in emitted(M.mixed_documents(docs)).items():
            assert abs(t - taken[source]) <= words / 2 + 1
        each = [r["count"] for r in M.mixed_documents(docs).filter("source = 'a'").groupBy("k").count().collect()]
        assert max(each) - min(each) <= 1


def test_any_column_names_and_the_order_of_slots(spark):
    rows = [(k, f"{'w ' * 300}{k}", "ab"[k % 2], k) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_content long").withColumns({c: F.col("doc_id") * 3 for c in ("mix_copy", "mix_times", "mixed_0", "mixed_1", "mixed_7", "content", "slot", "taken", "c", "i", "s")})
    out = M.mixed_documents(docs, slot_col="first")
    assert out.columns == [*docs.columns, "first"]
    got = out.collect()
    assert all(r["mix_content"] == r["doc_id"] and r["mix_copy"] == r["mixed_1"] == r["slot"] == r["s"] == 3 * r["doc_id"] for r in got)
    slots = {r["doc_id"]: r["first_slot"] for r in M.mix_sources(docs).collect()}
    assert {(r["doc_id"], r["first"]) for r in got} <= set(slots.items())
    assert M.mixed_documents(docs.limit(0)).columns == docs.columns and M.mixed_documents(docs.limit(0)).count() == 0
