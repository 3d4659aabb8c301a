"""Ranked lexical search by TPUT over postings that are partitioned by term.

Postings (term, document, occurrences) of the queries' terms are written once,
in an order by term. Then, as the three-phase uniform threshold algorithm says:
the k highest entries of each list give partial sums, whose k-th highest is a
lower bound of a query's result; a document that could reach it has at least
one entry of the bound divided by the query's number of terms, so every list is
read down to that uniform threshold; the sums over what was read, plus the
threshold for each term that was not, bound every document from above, and the
few that may still be among the k highest are looked up exactly.

Queries are taken in blocks whose terms are bounded in number, as a block's
terms are broadcast; any number of blocks gives the same result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.llm.base import cut, durable_dir, lean

#: Fixed value: in UTF-8 with A-Z lower-cased, the bytes of terms.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TOP = 50
#: (query, term) pairs of a block of queries, about; cells of the table of sums that a task holds.
BLOCK_TERMS, CELLS = 200_000, 1 << 22
#: A list is in so many parts, by the document, as a term may be in every document.
SALTS = 16


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return TERM.findall(text.lower()) if text else []


def _raw(x) -> bytes | None:
    return bytes(x.as_buffer()) if x.is_valid else None


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, item_id, term): the distinct terms of each row of `queries`, which gets a number of its own."""

    def run(batches):
        for b in batches:
            out = [(q, i, t) for q, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for t in sorted(set(terms(_raw(x))))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["query", "item_id", "term"])

    return queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "query long, item_id long, term binary")


class Queries:
    """The terms of a block of queries: numbers of terms, and the queries of each term by number."""

    def __init__(self, rows):
        self.ids = sorted({(r["query"], r["item_id"]) for r in rows}, key=lambda x: x[0])
        self.vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        number = {q: i for i, (q, _) in enumerate(self.ids)}
        pairs = np.array(sorted((self.vocabulary[bytes(r["term"])], number[r["query"]]) for r in rows), np.int64).reshape(-1, 2)
        #: Queries of term t: query[begin[t] : begin[t + 1]].
        self.query, self.begin = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 1))
        self.size = np.bincount(self.query, minlength=len(self.ids))


def postings(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, key, doc_id, tf, n) for the terms of the broadcast `vocabulary`, and rows of term -1 whose tf and n count documents with terms and all terms."""

    def run(batches):
        known = vocabulary.value
        documents = length = 0
        for b in batches:
            term, row, tf, n = [], [], [], []
            for i, x in enumerate(b.column(2)):
                found = terms(_raw(x))
                if found:
                    documents += 1
                    length += len(found)
                    own = Counter(filter(known.__contains__, found))
                    term += map(known.__getitem__, own)
                    tf += own.values()
                    row += [i] * len(own)
                    n += [len(found)] * len(own)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], names=["term", "key", "doc_id", "tf", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([documents], pa.int64()), pa.array([length], pa.int64())], names=["term", "key", "doc_id", "tf", "n"])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "term int, key long, doc_id long, tf long, n long")


def _heads(k: int):
    """Entries sorted by list -> the k highest of each list in each batch."""

    def run(batches):
        for b in batches:
            term, c = b.column(0).to_numpy(), b.column(2).to_numpy()
            order = np.lexsort((-c, term))
            begin = np.flatnonzero(np.diff(term[order], prepend=-2))
            place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            yield b.take(pa.array(order[place < k]))

    return run


def _sums(given, k: int):
    """Entries (key, doc_id, term, c) sorted by key -> (query, key, doc_id, sum, most) that may be among a query's k highest.

    A query's bound rises with the sums that this task has seen.
    """

    def run(batches):
        queries, begin, size_of, least, bound = given.value
        bound, width = bound.copy(), len(size_of)
        highest = np.zeros((width, 0), np.int64)
        step = max(1, CELLS // max(1, width))

        def summed(t):
            nonlocal bound, highest
            key, term, c = t.column("key").to_numpy(), t.column("term").to_numpy(), t.column("c").to_numpy()
            fresh = np.flatnonzero(np.diff(key, prepend=-1))
            doc = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
            for d in range(0, len(fresh), step):
                upto = fresh[d + step] if d + step < len(fresh) else len(key)
                rows = slice(fresh[d], upto)
                size = min(step, len(fresh) - d)
                # An entry counts for each query that has its term.
                first, times = begin[term[rows]], np.diff(begin)[term[rows]]
                entry = np.repeat(np.arange(len(times)), times)
                query = queries[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(entry))]
                cell = (doc[rows][entry] - d) * width + query
                total = np.bincount(cell, c[rows][entry], size * width).astype(np.int64).reshape(size, width)
                read = np.bincount(cell, minlength=size * width).reshape(size, width)
                most = total + (size_of - read) * np.maximum(least - 1, 0)
                some = np.vstack([highest.T, total]) if highest.size else total
                highest = (np.partition(some, len(some) - k, axis=0)[len(some) - k :] if len(some) > k else some).T
                if highest.shape[1] == k:
                    bound = np.maximum(bound, highest.min(axis=1))
                at, q = np.nonzero((total > 0) & (most >= bound))
                source = pa.array(fresh[d + at])
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), t.column("key").combine_chunks().take(source), t.column("doc_id").combine_chunks().take(source), pa.array(total[at, q]), pa.array(most[at, q])], names=["query", "key", "doc_id", "sum", "most"])

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [rest, b])
            key = t.column("key").to_numpy()
            last = np.searchsorted(key, key[-1]) if len(key) else 0
            if last:
                yield from summed(t.slice(0, last))
            rest = pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.slice(last).columns], names=t.column_names)
        if rest is not None and rest.num_rows:
            yield from summed(pa.Table.from_batches([rest]))

    return run


def _best(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def _ranked_block(docs: DataFrame, rows: list, top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    block = Queries(rows)
    vocabulary = spark.sparkContext.broadcast(block.vocabulary)
    folder = f"{durable_dir(spark)}/postings-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings(docs, vocabulary, id_col, text_col).repartition(parts, "term", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    dealt.sortWithinPartitions("term").write.parquet(folder)
    kept = spark.read.parquet(folder)

    # A row for each term of the block, and one for the whole.
    counts = {r["term"]: r for r in kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.sum("n").alias("n")).collect()}
    whole = counts.pop(-1, None)
    documents, length = (whole["tf"], whole["n"]) if whole else (0, 0)
    weight = np.zeros(len(block.vocabulary), np.int64)
    for t, r in counts.items():
        weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    schema = "term int, w long, least long"

    def entries(least) -> DataFrame:
        """Contributions of at least `least` (by term); the broadcast has a row for each term of the block."""
        table = spark.createDataFrame([(t, int(w), int(x)) for t, (w, x) in enumerate(zip(weight, least, strict=True)) if w > 0], schema)
        m = f"(50 + (50 * n * {documents}L) div {max(length, 1)}L)"
        return kept.filter("term >= 0").join(F.broadcast(table), "term").withColumn("c", F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 20 * {m}))")).filter("c > 0 and c >= least").select("term", "key", "c", "doc_id")

    none = np.zeros(len(weight), np.int64)
    of_query = spark.createDataFrame([(t, int(q)) for t in range(len(weight)) for q in block.query[block.begin[t] : block.begin[t + 1]]], "term int, query int")
    # Heads of the lists, and the lower bounds that they give.
    heads = entries(none).mapInArrow(lean(_heads(top)), "term int, key long, c long, doc_id long")
    place = F.row_number().over(W.partitionBy("term").orderBy(F.desc("c"), "key"))
    heads = heads.withColumn("place", place).filter(F.col("place") <= top).drop("place")
    partial = heads.join(F.broadcast(of_query), "term").groupBy("query", "key").agg(F.sum("c").alias("sum"))
    bound = np.zeros(len(block.ids), np.int64)
    for r in _best(partial, top, F.desc("sum")).filter(F.col("rank") == top).collect():
        bound[r["query"]] = r["sum"]
    # A document below this in each of a query's lists is below the bound.
    least = -(-bound // np.maximum(block.size, 1))
    lowest = np.full(len(weight), np.iinfo(np.int64).max)
    np.minimum.at(lowest, np.repeat(np.arange(len(weight)), np.diff(block.begin)), least[block.query])
    given = spark.sparkContext.broadcast((block.query, block.begin, block.size, least, bound))
    read = entries(lowest).repartition("key").sortWithinPartitions("key").select("key", "doc_id", "term", "c")
    sums = cut(read.mapInArrow(lean(_sums(given, top)), "query int, key long, doc_id long, sum long, most long"))
    second = _best(sums, top, F.desc("sum")).filter(F.col("rank") == top).select("query", F.col("sum").alias("bound"))
    open_ = sums.join(F.broadcast(second), "query", "left").filter("bound is null or most >= bound").select("query", "key", "doc_id")
    # Exact scores of what may still be among the highest.
    wanted = open_.join(entries(none).select("key", "term", "c"), "key").join(F.broadcast(of_query.withColumnRenamed("query", "q")), "term").filter("q = query")
    exact = wanted.groupBy("query", "key", "doc_id").agg(F.sum("c").alias("score"))
    names = spark.createDataFrame([(i, item) for i, (_, item) in enumerate(block.ids)], "query int, item_id long")
    return _best(exact, top, F.desc("score"), F.asc_nulls_last("doc_id"), "key").join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `queries` its `top` documents of the highest score above 0.

    Null, empty and term-less texts are no documents and score nowhere; such
    queries have no rows. Equal scores go by the smaller id, null ids last.
    Rows that repeat an id are documents of their own, and so are repeated
    queries, which give equal rows. Other columns are not read. Empty tables:
    empty result. A block's (query, term) pairs are broadcast: `block_terms`,
    or one query's own if these are more.
    """
    spark = docs.sparkSession
    pairs = cut(query_terms(queries, item_col, query_col))
    blocks = max(1, -(-pairs.count() // block_terms))
    out = None
    for k in range(blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).collect()
        if rows:
            found = _ranked_block(docs, rows, top, id_col, text_col)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
