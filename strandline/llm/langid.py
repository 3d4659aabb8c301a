"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams, hashed into a fixed
number of rows; a linear layer turns the mean into a score for each language.
Both are trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows. A temperature and a rejection threshold are fitted on rows
that training did not see.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import lean

BITS, GRAMS, DIMENSION = 14, (2, 3, 4), 16
#: The sample to learn from: rows of each language, and the languages there may be.
ROWS_PER_LANGUAGE, MAX_LANGUAGES = 600, 256
EPOCHS, RATE, SEED = 8, 2.0, 11
#: Share of accepted held-back rows that must be right; characters of the extra short example made from a row.
ACCEPT_PRECISION, SHORT = 0.99, 48
CHUNK = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: ASCII other than letters counts as a space.
_CLEAN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the whole text."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN) + b" "
    out = np.zeros(1 << BITS)
    longest = max(GRAMS)
    for at in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + longest - 1], np.uint8).astype(np.uint32)
        own = min(CHUNK, len(raw) - at)
        for n in GRAMS:
            m = min(own, len(b) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ b[k : k + m]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def held_out(id_col):
    """Rows that no label may be learned from: crc32 of the id's text mod 5 is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class LanguageModel:
    """languages, embeddings, output layer, temperature, threshold."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.embedding = rng.uniform(-1, 1, (1 << BITS, DIMENSION)) / DIMENSION
        self.output = np.zeros((DIMENSION, len(languages)))
        self.bias = np.zeros(len(languages))
        self.temperature, self.threshold = 1.0, 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> LanguageModel:
        """rows: (n-gram numbers, their shares) of each example."""
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(rows))
        back = order[: len(rows) // 5]
        train = order[len(rows) // 5 :] if len(rows) >= 20 else order
        steps, step = EPOCHS * max(len(train), 1), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(train):
                ids, share = rows[i]
                rate = RATE * (1 - step / steps)
                step += 1
                mean = share @ self.embedding[ids]
                p = _softmax(mean @ self.output + self.bias)
                p[label[i]] -= 1
                back_mean = self.output @ p
                self.output -= rate * np.outer(mean, p)
                self.bias -= rate * 0.1 * p
                self.embedding[ids] -= rate * share[:, None] * back_mean
        if len(back):
            logits = np.stack([rows[i][1] @ self.embedding[rows[i][0]] @ self.output + self.bias for i in back])
            grid = np.geomspace(0.25, 8, 41)
            loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(back)), label[back]], 1e-12)).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            p = _softmax(logits / self.temperature)
            score, right = p.max(1), p.argmax(1) == label[back]
            by_score = np.argsort(-score, kind="stable")
            good = np.cumsum(right[by_score]) / np.arange(1, len(back) + 1) >= ACCEPT_PRECISION
            self.threshold = float(score[by_score][np.flatnonzero(good)[-1]]) if good.any() else 1.0
        return self

    def table(self) -> np.ndarray:
        """Each n-gram's contribution to the scores."""
        return self.embedding @ self.output


def _softmax(x):
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(text)
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / max(counts.sum(), 1)


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learn from rows that are not held out and have a language and a letter.

    The sample is chosen by the id's hash, about `rows_per_language` of each
    language; n-grams are counted on the executors, and at most twice the
    sample's size comes to the driver, each row bounded by the hash range.
    """
    learn = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.shiftrightunsigned(F.xxhash64(F.lit("lang"), F.col(id_col)), 1).alias("h"))
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([])
    bound = F.lit(-1).cast("long")
    for name, n in sizes.items():
        bound = F.when(F.col("lang") == name, F.lit(min(2**63 - 1, int(2.0**63 * min(1.0, rows_per_language / n))))).otherwise(bound)

    def run(batches):
        for b in batches:
            out = []
            for lang, text, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if has_letter(text):
                    at = h % max(1, len(text) - SHORT)
                    for part, t in enumerate((text, text[at : at + SHORT])):
                        ids, share = sparse(t)
                        out.append((lang, h, part, ids.astype(np.uint16).tobytes(), share.astype(np.float32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["lang", "h", "part", "ids", "share"])

    sample = learn.filter(F.col("h") <= bound).mapInArrow(lean(run), "lang string, h long, part int, ids binary, share binary")
    got = sample.orderBy("h", "part", "lang").limit(4 * rows_per_language * len(languages)).collect()
    rows = [(np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["share"], np.float32).astype(np.float64)) for r in got]
    number = {x: i for i, x in enumerate(languages)}
    return LanguageModel(languages).fit(rows, np.array([number[r["lang"]] for r in got], np.int64))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for each row of `docs`.

    A null text, or one without a letter, is `und` with score 0. score is the
    calibrated probability of lang_pred; accepted says whether it reaches the
    rejection threshold. Ties fall to the first language by code point.
    Without any labelled row every text is `und`. Repeated rows are repeated;
    other columns are not read. Empty table: empty result. No shuffle.
    """
    languages, temperature, threshold = model.languages, model.temperature, model.threshold
    table, bias = model.table().astype(np.float32), model.bias

    def run(batches):
        for b in batches:
            pred, score = [], []
            for x in b.column(2):
                text = x.as_py()
                if not languages or not has_letter(text):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                counts = gram_counts(text)
                p = _softmax(((counts.astype(np.float32) @ table).astype(np.float64) / counts.sum() + bias) / temperature)
                pred.append(languages[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([s >= threshold and q != UNKNOWN for s, q in zip(score, pred, strict=True)], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    chosen = docs.select(F.col(id_col).cast("long"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    return chosen.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
