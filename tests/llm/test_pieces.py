import math
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from strandline.llm import pieces as P
from tests.llm.cases import frame, rows, words


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary()


def every_segmentation(text, v):
    """All segmentations of a text by recursion, with their probabilities."""
    s = P.SPACE + text.replace(" ", P.SPACE)
    piece = {}
    for hashes, ids, weights, _ in v.tables:
        for h, i, w in zip(hashes.tolist(), ids.tolist(), weights.tolist(), strict=True):
            if i >= 0:
                piece[h] = (i, w)

    def h(x):
        out = 0
        for ch in x:
            out = v.step(out, ord(ch))
        return out

    def go(at):
        if at == len(s):
            yield (), 0.0
            return
        found = False
        for k in range(1, min(16, len(s) - at) + 1):
            if (p := piece.get(h(s[at : at + k]))) is not None:
                found = found or k == 1
                for rest, w in go(at + k):
                    yield (p[0], *rest), w + p[1]
        if not found:
            for rest, w in go(at + 1):
                yield (-1 - ord(s[at]), *rest), w + v.byte_weight * len(s[at].encode())

    out = dict(go(0))
    total = np.logaddexp.reduce(list(out.values()))
    return {k: math.exp(w - total) for k, w in out.items()}


def test_probabilities_and_exhaustion(vocabulary):
    for text in ("ab", "the cat", "é日x", "aaa"):
        want = every_segmentation(text, vocabulary)
        got = P.segment_block([P.row_key(text)], [text], vocabulary, len(want) + 3)[0]
        assert len(got) == len(want)
        for pieces, lp, _, q in got:
            assert math.exp(lp) == pytest.approx(want[tuple(pieces.tolist())], rel=1e-6)
            assert q == 0.0
        assert all(a[2] >= b[2] for a, b in pairwise(got))


def test_first_and_second_follow_the_law(vocabulary):
    text, n = "in a hat", 6000
    want = every_segmentation(text, vocabulary)
    got = P.segment_block([P.row_key(i) for i in range(n)], [text] * n, vocabulary, 2)
    first = Counter(tuple(g[0][0].tolist()) for g in got)
    second = Counter(tuple(g[1][0].tolist()) for g in got)
    expect = Counter()
    for a, p in want.items():
        for b, q in want.items():
            if a != b:
                expect[b] += p * q / (1 - p)
    for k, p in want.items():
        if p > 0.005:
            assert abs(first[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        if expect[k] > 0.005:
            assert abs(second[k] / n - expect[k]) < 5 * math.sqrt(expect[k] / n) + 1e-3
    assert all(tuple(g[0][0]) != tuple(g[1][0]) for g in got)


def test_inclusion_scores_are_unbiased(vocabulary):
    text, n, k = "in a hat", 4000, 3
    want = every_segmentation(text, vocabulary)
    got = P.segment_block([P.row_key(-i) for i in range(n)], [text] * n, vocabulary, k)
    # Weighted by 1 / inclusion, the drawn probabilities sum to one on average.
    sums = [sum(want[tuple(g[0].tolist())] / math.exp(g[3]) for g in one) for one in got]
    assert np.mean(sums) == pytest.approx(1.0, abs=0.05)


def test_long_tails_are_opened(vocabulary):
    old, P.OPEN = P.OPEN, 2
    try:
        got = P.segment_block([1], ["a b c d e f g h i j " * 3], vocabulary, 40)[0]
    finally:
        P.OPEN = old
    assert len({tuple(g[0].tolist()) for g in got}) == 40
    assert all(a[2] >= b[2] for a, b in pairwise(got))


def test_round_trip_and_edges(spark, vocabulary):
    got = P.sample_segmentations(frame(spark)).collect()
    assert all(r["round_trip"] for r in got)
    by = Counter(str(r["doc_id"]) for r in got)
    assert by["8"] == 2 and by["10"] == 4 and by["4"] == by["5"] == 1
    assert all(r["n_pieces"] == len(r["pieces"]) for r in got)
    empty = [r for r in got if r["doc_id"] in (4, 5)]
    assert all(r["pieces"] == [] and r["log_prob"] == 0 for r in empty)
    assert P.sample_segmentations(frame(spark, True)).count() == 0
    back = {(r["doc_id"], r["text"]) for r in P.decode_pieces(P.sample_segmentations(frame(spark))).collect()}
    assert back == {(r[0], r[1] or "") for r in rows()}


def test_batches_do_not_matter(vocabulary):
    texts = [words(30, i) for i in range(6)] + ["", None]
    together = P.segment_block([P.row_key(i) for i in range(8)], texts, vocabulary, 3)
    for i, t in enumerate(texts):
        alone = P.segment_block([P.row_key(i)], [t], vocabulary, 3)[0]
        assert [(a[0].tolist(), round(a[1], 6)) for a in alone] == [(a[0].tolist(), round(a[1], 6)) for a in together[i]]


@pytest.mark.parametrize("long_,few", [(1, 0), (1, 100), (3, 4), (10**9, 100)])
def test_parts_summed_alone_have_the_same_law(vocabulary, monkeypatch, long_, few):
    monkeypatch.setattr(P, "PARTED", 2)
    monkeypatch.setattr(P, "LONG", long_)
    monkeypatch.setattr(P, "FEW", few)
    for text in ("thecat", "aaab the", "é日x日本"):
        want = every_segmentation(text, vocabulary)
        got = P.segment_block([P.row_key(text)], [text], vocabulary, len(want) + 3)[0]
        assert len(got) == len(want)
        for pieces, lp, _, q in got:
            assert math.exp(lp) == pytest.approx(want[tuple(pieces.tolist())], rel=1e-6) and q == 0.0


def test_samples_do_not_depend_on_how_they_are_walked(vocabulary, monkeypatch):
    texts = [words(200, 1), words(200, 2).replace(" ", ""), "日本語のテキスト" * 50, "a" * 3000]
    keys = [P.row_key(i) for i in range(len(texts))]
    first = P.segment_block(keys, texts, vocabulary, 3)
    monkeypatch.setattr(P, "FEW", 0)
    for a, b in zip(first, P.segment_block(keys, texts, vocabulary, 3), strict=True):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]


def test_long_texts_without_spaces(vocabulary):
    import time

    spaced = words(40_000, 4)
    took = []
    for text in (spaced, spaced.replace(" ", ""), "日本語のテキスト" * 20_000):
        began = time.process_time()
        got = P.segment_block([7], [text], vocabulary, 2)[0]
        took.append((time.process_time() - began) / len(text.encode()))
        for pieces, *_ in got:
            assert vocabulary.decode(P.spelled(pieces, vocabulary.byte_id)) == text
    # A part that pieces span throughout is summed one character after another, yet in proportion to its length.
    assert max(took[1:]) < 12 * took[0]


def test_decoding_odd_rows(spark, vocabulary):
    ids = P.segment_block([1], ["a cat"], vocabulary, 1)[0][0][0]
    ids = [int(i) for i in P.spelled(ids, vocabulary.byte_id)]
    rows = [(1, ids, "old", "x"), (1, ids, "old", "x"), (2, None, "old", None), (None, [], "old", "y")]
    df = spark.createDataFrame(rows, "doc_id long, pieces array<int>, text string, `n pieces` string")
    got = P.decode_pieces(df)
    assert got.columns == ["doc_id", "n pieces", "text"]
    assert sorted((str(r[0]), str(r[1]), str(r[2])) for r in got.collect()) == [("1", "x", "a cat"), ("1", "x", "a cat"), ("2", "None", "None"), ("None", "y", "")]
    assert P.decode_pieces(df.limit(0)).count() == 0
