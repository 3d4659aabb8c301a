import numpy as np
import pytest

from strandline.llm import langid as L
from strandline.llm import quality as Q
from tests.llm.cases import frame, rows, words

PATH = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    model = L.train_language_model(docs)
    got = L.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_is_not_read_when_predicting(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    model = L.train_language_model(docs)
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    a = {r["doc_id"]: r["score"] for r in L.identify_languages(docs, model).collect()}
    b = {r["doc_id"]: r["score"] for r in L.identify_languages(other, model).collect()}
    assert a == b


def test_language_of_odd_rows(spark):
    docs = frame(spark)
    got = L.identify_languages(docs, L.train_language_model(docs)).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got}
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[6]["lang_pred"] == "und" and by[5]["score"] == 0
    assert by[8]["lang_pred"] in ("en", "de", "fr")
    none = L.identify_languages(docs, L.train_language_model(frame(spark, True))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_grams_of_chunks():
    text = words(200, 5)
    whole = L.gram_counts(text)
    old, L.CHUNK = L.CHUNK, 64
    try:
        assert (L.gram_counts(text) == whole).all()
    finally:
        L.CHUNK = old


def test_softmax_gradient_learns_two_classes():
    rng = np.random.default_rng(0)
    data = [(np.sort(rng.choice(np.arange(k * 500, k * 500 + 400), 30, replace=False)), np.full(30, 1 / 30)) for k in (0, 1) for _ in range(40)]
    label = np.repeat([0, 1], 40)
    m = L.LanguageModel(["a", "b"]).fit(data, label)
    p = [int(((s @ m.embedding[i]) @ m.output + m.bias).argmax()) for i, s in data]
    assert (np.array(p) == label).all()


def test_attention_gradient():
    rng = np.random.default_rng(1)
    m = Q.Attention()
    m.p["w"] = rng.normal(size=Q.HIDDEN)
    x, starts, y = rng.normal(size=(7, Q.FEATURES)), np.array([0, 3]), np.array([1.0, 0.0])

    def loss():
        s = m.forward(x, starts)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = m.gradient(x, starts, y)
    for k, at in (("w1", (2, 3)), ("v", (1, 2)), ("u", (4, 5)), ("a", (3,)), ("w", (6,)), ("b", (0,)), ("b1", (2,))):
        keep = m.p[k][at]
        m.p[k][at] = keep + 1e-6
        up = loss()
        m.p[k][at] = keep - 1e-6
        down = loss()
        m.p[k][at] = keep
        assert (up - down) / 2e-6 == pytest.approx(grad[k][at], rel=1e-3, abs=1e-7)


def test_attention_forward_by_hand():
    rng = np.random.default_rng(2)
    m = Q.Attention()
    m.p = {k: rng.normal(size=v.shape) * 0.3 for k, v in m.p.items()}
    m.mean, m.scale = rng.normal(size=Q.FEATURES), 1 + rng.random(Q.FEATURES)
    bags = [rng.normal(size=(n, Q.FEATURES)) for n in (1, 4, 2)]
    for bag, score in zip(bags, m.score(bags), strict=True):
        hidden = [[np.tanh(sum((x[i] - m.mean[i]) / m.scale[i] * m.p["w1"][i, j] for i in range(Q.FEATURES)) + m.p["b1"][j]) for j in range(Q.HIDDEN)] for x in bag]
        weight = []
        for h in hidden:
            gate = [np.tanh(np.dot(h, m.p["v"][:, k])) / (1 + np.exp(-np.dot(h, m.p["u"][:, k]))) for k in range(Q.ATTENTION)]
            weight.append(np.exp(np.dot(gate, m.p["a"])))
        whole = sum(w * np.array(h) for w, h in zip(weight, hidden, strict=True)) / sum(weight)
        assert score == pytest.approx(1 / (1 + np.exp(-(np.dot(whole, m.p["w"]) + m.p["b"][0]))), abs=2e-9)


def trigrams(passage):
    """The hashed subwords of one passage of a text that has no other, counted one by one."""
    raw = b" " + bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in passage.encode()) + b" "
    out = np.zeros(Q.SUBWORDS)
    for i in range(1, len(raw) - 1):
        if passage.encode()[i - 1 : i].isspace():
            continue
        a, b, c = raw[i - 1 : i + 2]
        h = ((a * 0x9E3779B1 + b * 0x85EBCA77 & 0xFFFFFFFF) ^ c * 0xC2B2AE3D & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF
        out[h >> 23] += 1
    return np.sqrt(out / max(out.sum(), 1))


def test_subwords_reach_the_encoder():
    for text in ("a", "Some WORDS\tand a few\nmore é!", "xx " * 50):
        assert np.allclose(Q.passage_features(text)[0, -Q.SUBWORDS :], trigrams(text), atol=1e-6)
    # Words with their letters in another order have the same characters and lengths, but other subwords.
    text = words(60, 9)
    salad = " ".join(w[::-1] for w in text.split())
    a, b = Q.passage_features(text)[0], Q.passage_features(salad)[0]
    assert np.allclose(a[: -Q.SUBWORDS], b[: -Q.SUBWORDS]) and np.abs(a - b).sum() > 1
    rng = np.random.default_rng(3)
    good = [Q.passage_features(words(80, i)) for i in range(60)]
    bad = [Q.passage_features(" ".join("".join(rng.permutation(list("klmnopqrst"))[: rng.integers(2, 8)]) for _ in range(80))) for i in range(60)]
    model = Q.Attention().fit(good[:40] + bad[:40], np.repeat([1.0, 0.0], 40))
    assert model.score(good[40:]).min() > 0.5 > model.score(bad[40:]).max()


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/labels.parquet")
    model = Q.train_quality_model(docs, labels)
    got = Q.score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (got[got["quality"] == 1]["predicted"] == 1).mean() > 0.97


def test_quality_of_odd_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (4, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = Q.train_quality_model(docs, labels)
    got = Q.score_quality(docs, model)
    assert got.count() == len(rows()) and got.columns.count("score") == 1
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[4]["score"] == by[5]["score"] == by[6]["score"] and by[1]["score"] == by[2]["score"]
    assert Q.score_quality(frame(spark, True), model).count() == 0
    none = Q.train_quality_model(docs, labels.limit(0))
    kept = Q.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() in (0, len(rows()))


def test_features_of_long_text():
    x = Q.passage_features(words(1000, 3))
    assert x.shape == (16, Q.FEATURES) and np.isfinite(x).all()
    assert Q.passage_features(None).shape == (1, Q.FEATURES)
    repeated = Q.passage_features("same words here " * 200)
    assert repeated[-1, Q.CLASSES] > 0.8 > x[0, Q.CLASSES]


def test_language_scores_by_hand(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(300)
    model = L.train_language_model(docs)
    for text in ("Die Einheit der Welt 12", "the house, on", "é"):
        raw = b" " + bytes(c if c > 127 or chr(c).isalpha() else 32 for c in text.lower().encode()) + b" "
        counts = {}
        for n in L.GRAMS:
            for i in range(len(raw) - n + 1):
                h = n
                for k in range(n):
                    h = (h ^ raw[i + k]) * int(L._MULTIPLIERS[k]) & 0xFFFFFFFF
                    h ^= h >> 15
                counts[h >> (32 - L.BITS)] = counts.get(h >> (32 - L.BITS), 0) + 1
        total = sum(counts.values())
        mean = sum(c / total * model.embedding[i] for i, c in counts.items())
        logits = [(sum(mean[j] * model.output[j, k] for j in range(L.DIMENSION)) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        p = np.exp(np.array(logits) - max(logits))
        p /= p.sum()
        got = L.identify_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        assert got["lang_pred"] == model.languages[int(p.argmax())] and got["score"] == pytest.approx(p.max(), abs=1e-5)
        assert got["accepted"] == (got["score"] >= model.threshold)
