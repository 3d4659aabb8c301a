"""Importance resampling toward a target distribution, over hashed n-grams.

Documents are read in blocks of bounded size. A block's distinct words get
integer ids, an n-gram is a tuple of ids, and each distinct tuple's bytes are
hashed once for the block: a longer tuple continues the hash of its prefix with
a space and the bytes of its last word. Hashes and counts are then joined back
to the occurrences by the tuples' numbers. Only histograms over the buckets and
one row a document are shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.llm.base import cut, lean

#: In UTF-8 with A-Z lower-cased, the bytes of words.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS, ORDER = 10_000, 3
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK = 4 << 20
LEAST_WORDS, SHARE, SEED = 20, (5, 100), 42


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8."""
    return WORD.findall(text.lower()) if text else []


def blocks(batches, text_at: int = 0):
    """(first row, rows, words of all of them, number of words of each) of each block of a batch, with the batch."""
    for b in batches:
        first, found, sizes, load = 0, [], [], 0
        for i, x in enumerate(b.column(text_at)):
            raw = bytes(x.as_buffer()) if x.is_valid else b""
            own = words(raw)
            found += own
            sizes.append(len(own))
            load += len(raw)
            if load >= BLOCK:
                yield b, first, found, np.array(sizes)
                first, found, sizes, load = i + 1, [], [], 0
        if sizes:
            yield b, first, found, np.array(sizes)


def features(found: list[bytes], sizes: np.ndarray, order: int = ORDER, buckets: int = BUCKETS):
    """For n = 1 .. order: (bucket of each distinct n-gram, its number for each occurrence, the text of each occurrence)."""
    number: dict = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    glued = [b" " + w for w in number]
    of = np.repeat(np.arange(len(sizes)), sizes)
    crc = [zlib.crc32(w) for w in number]
    width, start, at = max(1, len(number)), np.arange(len(found)), ids
    out = [(np.array(crc, np.int64) % buckets, at, of)]
    for n in range(1, order):
        # A tuple is the number of its prefix and of its last word. Both are below the number of occurrences, so a code fits.
        go_on = np.flatnonzero((start + n < len(found)) & (of[np.minimum(start + n, len(found) - 1)] == of[start]))
        start = start[go_on]
        distinct, at = np.unique(at[go_on] * width + ids[start + n], return_inverse=True)
        crc = list(map(zlib.crc32, map(glued.__getitem__, (distinct % width).tolist()), map(crc.__getitem__, (distinct // width).tolist())))
        out.append((np.array(crc, np.int64) % buckets, at, of[start]))
    return out


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket; buckets without any have no row.

    Null and empty texts have no words. Empty table: empty result. A task
    gives one row a bucket, whatever it reads.
    """

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, found, sizes in blocks(batches):
            for bucket, at, _ in features(found, sizes, order, buckets):
                total += np.bincount(bucket, np.bincount(at, minlength=len(bucket)), buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to source) for each bucket; both: (bucket, n), a row for each bucket at most."""

    def dense(counts):
        out = [0] * buckets
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = dense(source), dense(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise of an id in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row of `docs`."""
    given = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = given.value
        for b, first, found, sizes in blocks(batches, 1):
            weight = np.zeros(len(sizes), np.int64)
            for bucket, at, of in features(found, sizes, order, len(gain)):
                weight += np.bincount(of, gain[bucket][at], len(sizes)).astype(np.int64)
            n = sum(np.maximum(sizes - k, 0) for k in range(order))
            ids = b.column(0).slice(first, len(sizes))
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of `docs`; rank: place among the drawn, null if it is not.

    Of the N rows with at least `least_words` words, floor(share * N) with the
    highest scores are drawn, ties by the smaller id (null last), equal ids in
    any order. Null and empty texts have no features, weight 0, and take no
    part in the draw. Repeated rows are rows of their own, with equal scores.
    Without a target all counts are smoothed to the source's. Other columns are
    not read. Empty table: empty result. The draw is a range sort: a place is
    the rows of earlier partitions and those before it in its own.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, "text", order, buckets), buckets)
    scored = cut(score_documents(docs, gains, id_col, text_col, order, seed))
    able = scored.filter(F.col("n_words") >= least_words)
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = able.repartitionByRange(parts, F.desc("score"), F.asc_nulls_last("doc_id")).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"))
    # The upper bits of this number are the partition's, the lower 33 the row's place in it.
    placed = cut(ordered.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"), F.sum("rows").over(W.partitionBy(F.lit(0))).alias("all"))
    rank = F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1
    drawn = rank <= F.expr(f"all * {share[0]} div {share[1]}")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    some = placed.join(F.broadcast(offsets), "part").select(*columns, F.when(drawn, rank).alias("rank"))
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return some.unionByName(rest)
