"""Importance resampling: against a plain count of all features, block bounds and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from strandline.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def listed(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return ws, [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute(docs, target):
    def counts(texts):
        out = [0] * 10_000
        for t in texts:
            for f in listed(t)[1]:
                out[zlib.crc32(f.encode()) % 10_000] += 1
        return out

    s, t = counts([d[1] for d in docs]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        ws, fs = listed(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r, rank[r].pop() if rank.get(r) else None) for r in rows), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"Wort{k}" if k % 5 else f"ÄÖ{k}é" for k in range(80)]
    docs = [(i, ", ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 19, 20, 60])))) for i in range(300)]
    docs += [(300 + i, docs[6][1]) for i in range(30)] + [(900, None), (901, ""), (902, "?!"), (903, "long word " * 30_000), (None, "a b c " * 9)]
    return docs, [" ".join(rng.choices(words[:20], k=30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("block", [1, 300, 4 << 20])
def test_against_counting_every_feature(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    docs, target = corpus(block)
    found = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, target)


def test_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(25))
    docs = [(1, text)] * 40 + [(2, "w1 w2"), (None, text)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", resample.F.lit("x")).withColumn("part", resample.F.lit(1))
    found = sorted(map(tuple, resample.resample(frame, spark.createDataFrame([(text,)], "text string")).collect()), key=repr)
    assert found == brute(docs, [text])
    assert sorted(r[5] for r in found if r[5]) == [1, 2]


def test_tuples_are_hashed_once(monkeypatch):
    calls = []
    real = zlib.crc32
    monkeypatch.setattr(resample.zlib, "crc32", lambda *a: calls.append(a) or real(*a))
    found = [b"a", b"b", b"a", b"b", b"a", b"b", b"c"]
    out = resample.features(found, resample.np.array([6, 1]))
    # Three words, (a b) and (b a), (a b a) and (b a b); none across texts.
    assert len(calls) == 3 + 2 + 2
    assert [len(o[1]) for o in out] == [7, 5, 4]
    assert sorted(out[2][0].tolist()) == sorted(real(x) % 10_000 for x in (b"a b a", b"b a b"))


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "too few words")]])
def test_empty_tables(spark, docs):
    found = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, [])
