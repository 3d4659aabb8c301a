from collections import defaultdict

from strandline.llm import sharding as H
from tests.llm.cases import frame, rows


def check(got, n, shards=8):
    assert len(got) == n
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    return by


def test_equal_bytes(spark):
    data = [(i, "x" * (i * 37 % 900)) for i in range(4000)]
    got = H.histogram_shards(spark.createDataFrame(data, "doc_id long, text string")).collect()
    by = check(got, 4000)
    total = sum(r["size"] for r in got)
    assert total == sum(len(t) + 1 for _, t in data)
    for rs in by.values():
        assert abs(sum(r["size"] for r in rs) - total / 8) <= 2 * 901


def test_hot_text_is_split_and_others_stay_together(spark):
    data = [(i, "hot text " * 5 if i % 3 == 0 else f"text {i // 10} " * 4) for i in range(3000)]
    got = H.histogram_shards(spark.createDataFrame(data, "doc_id long, text string")).collect()
    by = check(got, 3000)
    sizes = [sum(r["size"] for r in rs) for rs in by.values()]
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes)
    shard = {r["doc_id"]: r["shard"] for r in got}
    groups = defaultdict(set)
    for i, t in data:
        groups[t].add(shard[i])
    assert sum(len(s) > 1 for s in groups.values()) <= 8


def test_odd_rows(spark):
    got = H.histogram_shards(frame(spark)).collect()
    check(got, len(rows()))
    sizes = {r["doc_id"]: r["size"] for r in got}
    assert sizes[5] == sizes[4] == 1 and sizes[9] == len(rows()[8][1].encode()) + 1
    assert H.histogram_shards(frame(spark, True)).count() == 0
    again = H.histogram_shards(frame(spark).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_splitters_are_exact(spark):
    keyed = spark.createDataFrame([(k, 1 + k % 5) for k in range(0, 1 << 20, 97)], "key long, size long")
    keys = H.find_splitters(keyed, 4, 0.0)
    rows_ = [(k, 1 + k % 5) for k in range(0, 1 << 20, 97)]
    total = sum(s for _, s in rows_)
    for i, k in enumerate(keys):
        below = sum(s for key, s in rows_ if key < k)
        assert abs(below - total * (i + 1) / 4) <= 5
