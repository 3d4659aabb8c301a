"""Quality classifier: gated-attention multiple-instance learning over passages.

Every passage of 64 words becomes a feature vector: shares of its hashed
subwords (byte trigrams, words with their borders), shares of kinds of
characters, repetition within the passage and against the text before it, word
lengths. An encoder, whose first layer holds an embedding of each hashed
subword, maps it to a hidden vector, gated attention weighs the
passages, and the weighted sum is scored. Encoder, attention and scorer are
trained together from document labels, in numpy, on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import lean
from strandline.llm.langid import held_out

PASSAGE_WORDS, HIDDEN, ATTENTION = 64, 32, 16
#: Labelled rows to learn from; passages that a row of the sample may have (a prediction reads all).
SAMPLE_ROWS, SAMPLE_PASSAGES = 4000, 24
#: Subwords are hashed to so many places.
SUBWORDS = 512
EPOCHS, BATCH, RATE, DECAY, SEED = 24, 64, 3e-3, 1e-4, 23
KEEP = 0.3
#: Words that are worked on at once.
BLOCK_WORDS = 1 << 15

#: Character classes: lower-case letters, upper case, digits, each other printable ASCII character, white space, bytes of longer characters.
_OTHER = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c == 10 else 4 if _c <= 32 or _c == 127 else 5 if 128 <= _c < 192 else 6 if _c >= 192 else 7 + _OTHER.index(_c)
CLASSES = 7 + len(_OTHER)
FEATURES = CLASSES + 8 + SUBWORDS
_G1, _G2, _G3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def passage_features(text: str | None) -> np.ndarray:
    """(passages, FEATURES), at least one row; a text without words is one passage of zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(words) // PASSAGE_WORDS)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    of = np.arange(len(words)) // PASSAGE_WORDS
    size = np.bincount(of, minlength=n).astype(np.float64)
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    starts = ~space
    starts[1:] &= space[:-1]
    word_of = np.cumsum(starts, dtype=np.int32) - 1
    passage = np.maximum(word_of, 0) // PASSAGE_WORDS
    chars = np.bincount(passage * CLASSES + _CLASS[b], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    share = chars / np.maximum(chars.sum(1, keepdims=True), 1)

    def repeated(keys):
        """Share of each passage's words whose key came before, in the passage and in the text."""
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        near = same & (of[order][1:] == of[order][:-1])
        return (np.bincount(of[order][1:][x], minlength=n) / size for x in (near, same))

    with np.errstate(over="ignore"):
        pairs = hashes.copy()
        pairs[1:] += hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
        triples = pairs.copy()
        triples[2:] += hashes[:-2] * np.uint64(0xC2B2AE3D27D4EB4F)
    mean = np.bincount(of, lengths, n) / size
    spread = np.sqrt(np.maximum(np.bincount(of, lengths.astype(np.float64) ** 2, n) / size - mean**2, 0))
    extra = [*repeated(hashes), *repeated(triples), mean / 10, spread / 10, np.log1p(size) / 4, np.full(n, np.log1p(len(words)) / 10)]
    # Trigrams of lower-case bytes, any white space as one; each belongs to the passage of its middle.
    low = b.astype(np.uint32) | np.where((b >= 65) & (b <= 90), np.uint32(32), np.uint32(0))
    low[space] = 32
    low = np.concatenate((np.full(1, 32, np.uint32), low, np.full(1, 32, np.uint32)))
    mixed = (low[:-2] * _G1 + low[1:-1] * _G2 ^ low[2:] * _G3) * _G1
    at = passage * SUBWORDS + (mixed >> np.uint32(32 - (SUBWORDS - 1).bit_length())).astype(np.int64)
    grams = np.bincount(at[~space], minlength=n * SUBWORDS).reshape(n, SUBWORDS).astype(np.float32)
    grams = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1))
    return np.concatenate([np.sqrt(share), np.stack(extra, axis=1), grams], axis=1).astype(np.float32)


class Attention:
    """Parameters and both passes. Bags are passages one after another with the start of each bag."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        weight = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"w1": weight(FEATURES, HIDDEN), "b1": np.zeros(HIDDEN), "v": weight(HIDDEN, ATTENTION), "u": weight(HIDDEN, ATTENTION), "a": weight(ATTENTION, 1)[:, 0], "w": np.zeros(HIDDEN), "b": np.zeros(1)}

    @staticmethod
    def damping():
        """What is added to each feature's spread: single subwords are many and say little each."""
        return np.where(np.arange(FEATURES) < FEATURES - SUBWORDS, 1e-2, 4e-1)

    def forward(self, x, starts):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        count = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        alpha = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        return x, h, t, g, alpha, z, count, 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"], -40, 40)))

    def gradient(self, x, starts, y):
        p = self.p
        x, h, t, g, alpha, z, count, s = self.forward(x, starts)
        d = (s - y) / len(y)
        dz = d[:, None] * p["w"]
        dzr = np.repeat(dz, count, axis=0)
        da = (dzr * h).sum(1)
        de = alpha * (da - np.repeat(np.add.reduceat(alpha * da, starts), count))
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = alpha[:, None] * dzr + dt @ p["v"].T + dg @ p["u"].T
        dpre = dh * (1 - h * h)
        return {"w1": x.T @ dpre, "b1": dpre.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "w": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> Attention:
        if not bags:
            return self
        n = sum(map(len, bags))
        self.mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
        self.scale = np.sqrt(sum(((b - self.mean) ** 2).sum(0) for b in bags) / n) + self.damping()
        rate = y.mean()
        self.p["b"][:] = np.log(max(rate, 1e-3) / max(1 - rate, 1e-3))
        rng = np.random.default_rng(SEED)
        m, v, step = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                x = np.concatenate([bags[i] for i in pick]).astype(np.float64)
                starts = np.cumsum([0] + [len(bags[i]) for i in pick[:-1]])
                step += 1
                for k, grad in self.gradient(x, starts, y[pick]).items():
                    grad = grad + DECAY * self.p[k]
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.p[k] = self.p[k] - RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        scores = self.forward(np.concatenate(bags).astype(np.float64), np.cumsum([0] + [len(b) for b in bags[:-1]]))[-1]
        # The last digits depend on the texts that are scored together.
        return scores.round(9)


def train_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Attention:
    """Learn from labelled rows that are not held out.

    At most `sample_rows` labels, chosen by the id's hash, are broadcast to
    find their texts; features are made on the executors. An id with several
    labels takes the smallest. Without labels the score is the same for all.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    sample = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(F.lit("quality"), F.col("id")), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def run(batches):
        for b in batches:
            out = []
            for i, text, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                x = passage_features(text)
                if len(x) > SAMPLE_PASSAGES:
                    x = x[np.sort(np.random.default_rng(SEED).choice(len(x), SAMPLE_PASSAGES, replace=False))]
                out.append((i, y, x.astype(np.float16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["id", "y", "x"])

    got = texts.select(F.col("id").cast("long"), "text", "y").mapInArrow(lean(run), "id long, y int, x binary").orderBy("id", "x").limit(2 * sample_rows).collect()
    return Attention().fit([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in got], np.array([float(r["y"]) for r in got]))


def _scores(column, model: Attention) -> np.ndarray:
    scores, bags, load = [], [], 0
    for x in column:
        bags.append(passage_features(x.as_py()))
        load += len(bags[-1])
        if load >= 1024:
            scores.append(model.score(bags))
            bags, load = [], 0
    return np.concatenate([*scores, model.score(bags)])


def keep_good(docs: DataFrame, model: Attention, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of `docs` that are not rejected, with their columns as they are. No shuffle.

    Null and empty texts are scored as one passage of zeros and go or stay
    together. Repeated rows and equal texts share their fate; other columns are
    not looked at, so their names cannot clash. Empty table: empty result.
    """

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(b.schema.get_field_index(text_col)), model) >= keep))

    return docs.mapInArrow(lean(run), docs.schema)


def score_quality(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """`docs` with `held_out`, `score` and `predicted` added (columns of these names are replaced).

    Null and empty texts are scored as one passage of zeros. Repeated rows and
    equal texts get equal scores. Empty table: empty result. No shuffle.
    """
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    shaped = docs.select(*rest, held_out(F.col(id_col)).alias("held_out"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shaped.schema.fields), "score double, predicted int"])
    at = rest.index(text_col)

    def run(batches):
        for b in batches:
            scores = _scores(b.column(at), model)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array((scores >= keep).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return shaped.mapInArrow(lean(run), schema)
