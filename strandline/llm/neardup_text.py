"""MinHash near-duplicates with SuperMinHash signatures.

A document is the set of its 5-word shingles. Equal sets form a class, and
only a class representative goes on. SuperMinHash gives each shingle a random
permutation of the slots; the value it offers to the slot at place j is j plus
a random fraction, so once every slot holds less than j, later places cannot
change anything and the document stops early. Bands of the signature propose
pairs, the full shingle sets confirm them, and union-find by contraction
groups what is linked.

Within a bucket members are first compared with the smallest one, which
settles most. Buckets that still hold several groups are then worked through
in pairs of blocks of bounded size: every member outside the bucket's largest
group meets all members of other groups there. A pair whose signatures agree
in too few slots for the similarity asked is passed over, a pair already in
one group is not looked at, and what a block returns is at most one link for
each of its rows, never a list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import cut, lean, sorted_groups
from strandline.llm.graph import components

SHINGLE_WORDS, SLOTS, BAND_ROWS = 5, 128, 4
PERCENT_SIMILAR = 75
#: Slots in which the signatures of a pair must agree to be confirmed in a block: 4.5 standard deviations below the similarity.
AGREE = 74
#: Rows and shingles that one block of a bucket holds, about.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20
#: Shingles handled at once; bounds the memory of a Python worker.
BLOCK = 1 << 16
#: Up to so many candidate ids are broadcast to find their texts (8 bytes each); beyond it the ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer words than a shingle has, of the whole sequence; no words: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - SHINGLE_WORDS + 1, 1)
    with np.errstate(over="ignore"):
        acc = np.full(n, min(len(h), SHINGLE_WORDS), np.uint64)
        for k in range(min(SHINGLE_WORDS, len(h))):
            acc = mix64(acc * _STEP + h[k : k + n])
    return np.unique(acc)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets, slots) of non-empty sets, all sets at once, place by place."""
    out = np.full((len(sets), slots), np.inf)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    with np.errstate(over="ignore"):
        seed = mix64(np.concatenate(sets)) if len(of) else np.empty(0, np.uint64)
        flat = out.reshape(-1)
        order = None
        for j in range(slots):
            if j:
                # A set whose slots are all below j is final.
                live = (out.max(axis=1) >= j)[of]
                if not live.any():
                    break
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(of), 1))
                    order[np.arange(len(of)), first] = 0
                if not live.all():
                    of, seed, order = of[live], seed[live], order[live]
            r = mix64(seed + np.uint64(j + 1) * _STEP)
            pick = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            if order is None:
                place = first = pick
            else:
                rows = np.arange(len(of))
                place = order[rows, pick].astype(np.int64)
                order[rows, pick] = order[:, j]
            np.minimum.at(flat, of * slots + place, j + (r >> np.uint64(32)).astype(np.float64) / 2.0**32)
    return out


def band_hashes(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """(sets, bands) of int64."""
    n, slots = signatures.shape
    parts = signatures.view(np.uint64).reshape(n, slots // rows, rows)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64), (n, slots // rows)) * _STEP
        for k in range(rows):
            acc = mix64(acc + parts[:, :, k])
    return acc.view(np.int64)


def _blocks(texts):
    """Lists of (row, set) with about BLOCK shingles each."""
    block, load = [], 0
    for i, t in enumerate(texts):
        s = shingle_set(t)
        block.append((i, s))
        load += len(s)
        if load >= BLOCK:
            yield block
            block, load = [], 0
    if block:
        yield block


def _signed(batches):
    bands = SLOTS // BAND_ROWS
    for b in batches:
        ids = b.column(0)
        for block in _blocks(x.as_py() for x in b.column(1)):
            sets = [s for _, s in block]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes, prints = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), SLOTS), np.uint16)
            if full:
                signatures = super_minhash([sets[i] for i in full])
                hashes[full] = band_hashes(signatures)
                prints[full] = (mix64(signatures.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(block[0][0], len(block)).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands, dtype=np.int32)), pa.array(hashes.reshape(-1))),
                    pa.array([x.tobytes() for x in prints], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "class", "bands", "prints"],
            )


def _sets(batches):
    for b in batches:
        ids = b.column(0)
        for block in _blocks(x.as_py() for x in b.column(1)):
            yield pa.RecordBatch.from_arrays([ids.slice(block[0][0], len(block)).cast(pa.int64()), pa.array([s.tobytes() for _, s in block], pa.binary())], names=["id", "set"])


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT_SIMILAR) -> bool:
    """100 * intersection >= percent * union, exactly, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(batches):
    for b in batches:
        a_id, b_id = b.column(0).to_pylist(), b.column(1).to_pylist()
        keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a_id, keep, strict=True) if k], pa.int64()), pa.array([x for x, k in zip(b_id, keep, strict=True) if k], pa.int64())], names=["a", "b"])


def full_sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, set) of the given distinct ids. texts: (id, text), one row or more an id."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return cut(texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(lean(_sets), "id long, set binary").dropDuplicates(["id"]))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return left.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b").mapInArrow(lean(_confirmed), "a long, b long")


def _joined(batches):
    """Blocks (bucket, bi, bj, side, rep, grp, prints, set) -> links (a, b) that join groups."""
    for g in sorted_groups(batches):
        rep, grp, side = (g.column(k).to_pylist() for k in ("rep", "grp", "side"))
        prints = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in g.column("prints")])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("set")]
        same = g.column("bi")[0].as_py() == g.column("bj")[0].as_py()
        first = [i for i, x in enumerate(side) if x == g.column("bi")[0].as_py()]
        second = first if same else [i for i, x in enumerate(side) if x == g.column("bj")[0].as_py()]
        if not first or not second:
            continue
        root: dict[int, int] = {}

        def find(x, root=root):
            while root.get(x, x) != x:
                x = root[x]
            return x

        found = []
        other = prints[second]
        for i in first:
            likely = np.flatnonzero((other == prints[i]).sum(axis=1) >= AGREE)
            for j in (second[k] for k in likely):
                a, b = find(grp[i]), find(grp[j])
                if a != b and similar(sets[i], sets[j]):
                    root[max(a, b)] = min(a, b)
                    found.append((rep[i], rep[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    Null, empty or blank text: no shingles, linked with nothing, a component
    of its own. Repeated rows and equal texts are one class and are never
    compared. Ties: the smallest id stands for a class and for a component.
    Other columns are not read. Empty table: empty result. A null id stays a
    row with a null component and kept null.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(texts.mapInArrow(lean(_signed), "doc_id long, n_shingles long, class binary, bands array<long>, prints binary"))
    own = signed.filter("class is not null and doc_id is not null").groupBy("class")
    classes = cut(own.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("prints").alias("prints")))
    in_bucket = classes.select("rep", F.explode("bands").alias("bucket"))
    smallest = in_bucket.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(in_bucket.join(smallest.select("bucket", "hub"), "bucket"))
    tried = cut(members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    ids = cut(tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).distinct())
    sets = full_sets(ids, texts)
    links = cut(confirm(tried, sets))
    grouped = components(links)

    # Buckets that still hold several groups. Blocks 0 .. outer-1 are of members outside the largest group.
    group = cut(members.join(grouped, members.rep == grouped.id, "left").select("bucket", "rep", F.coalesce("component", "rep").alias("grp")))
    per_group = group.groupBy("bucket", "grp").agg(F.count(F.lit(1)).alias("n"))
    main = per_group.groupBy("bucket").agg(F.max(F.struct("n", "grp")).alias("top"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    open_ = group.join(main.select("bucket", F.col("top.grp").alias("main")), "bucket").join(classes.select("rep", "n_shingles", "prints"), "rep")
    open_ = cut(open_.withColumn("out", (F.col("grp") != F.col("main")).cast("int")))
    blocks = lambda of: F.ceil(F.greatest(F.sum(of) / BLOCK_ROWS, F.sum(of * F.col("n_shingles")) / BLOCK_SHINGLES)).cast("int")
    sized = open_.groupBy("bucket").agg(blocks(F.col("out")).alias("outer"), blocks(1 - F.col("out")).alias("inner"))
    laid = open_.join(sized, "bucket").withColumn("side", F.when(F.col("out") == 1, F.pmod(F.xxhash64("rep"), "outer")).otherwise(F.col("outer") + F.pmod(F.xxhash64("rep"), "inner")).cast("int"))
    meets = F.filter(F.transform(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1), lambda k: F.struct(F.least(k, F.col("side")).alias("bi"), F.greatest(k, F.col("side")).alias("bj"))), lambda p: p["bi"] < F.col("outer"))
    placed = laid.withColumn("pair", F.explode(meets)).select("bucket", "pair.bi", "pair.bj", "side", "rep", "grp", "prints")
    dealt = placed.join(sets.withColumnRenamed("id", "rep"), "rep").select("bucket", "bi", "bj", "side", "rep", "grp", "prints", "set")
    dealt = dealt.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    more = cut(dealt.mapInArrow(lean(_joined), "a long, b long"))
    if not more.isEmpty():
        grouped = components(links.unionByName(more))

    of_class = classes.select("class", "rep").join(grouped, classes.rep == grouped.id, "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    # Rows that link with nothing stay where they are: joined, they would all meet in one task.
    shown = signed.select("doc_id", "n_shingles", "class")
    alone = F.col("class").isNull() | F.col("doc_id").isNull()
    out = shown.filter(~alone).join(of_class, "class", "left").unionByName(shown.filter(alone).withColumn("component_id", F.lit(None).cast("long")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row for each group of near-duplicates, columns as they are.

    Only the ids that go are moved: they are broadcast while they are few
    (BROADCAST_IDS), and joined by a shuffle beyond that. Rows that repeat an
    id are one document; rows without an id stay, and so do null, empty and
    word-less texts, which link with nothing. Empty table: empty result.
    """
    found = cut(near_duplicates(docs, id_col, text_col).filter("doc_id is not null"))
    gone = found.filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    kept = found.filter("kept").select("doc_id")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    out = docs.join(gone, id_col, "left_anti")
    if kept.count() > kept.distinct().count():
        out = out.filter(F.col(id_col).isNull()).unionByName(out.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
    return out.select(docs.columns)
