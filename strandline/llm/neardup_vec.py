"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and fast Hadamard
transforms; its hash is the signed axis it then lies closest to. A table joins
several such hashes. Besides its own bucket a vector enters the next likely
ones (second axes, by least loss), so a pair meets if any of their buckets
coincide. How many hashes a table joins follows from the number of vectors and
their width, how many tables there are from the chance that a pair at the
threshold meets in one table (found by hashing random such pairs) and the
recall asked for.

Only ids and short sketches travel to buckets, which are worked through in
blocks of bounded size. Buckets with the same members are one. A sketch has
the signs of random projections: two of them differ in more than a known
number of signs only if their vectors are below the threshold, but for a
chance of one in 10^9. What has no likely partner in a block is done with; the
vectors of the others then meet, and a block gives each of them its number of
links and its group, never a list of pairs. A pair is counted in the first
bucket it shares.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import cut, lean, sorted_runs
from strandline.llm.graph import components

COSINE, PROBES = 0.9, 4
#: Share of the pairs at the threshold that are to be met; tables there may be for it, else a table joins fewer hashes.
RECALL, MAX_TABLES = 0.995, 64
#: Buckets a table has for each vector, at least; and vectors of a bucket that one block holds.
SPARSE, BLOCK = 32, 512
#: Blocks of so few rows are verified together, many at a time; pairs that are at work at once.
SMALL, PAIRS = 16, 1 << 15
#: A bucket's number: its table, then bits of its hash.
TABLE_BITS, HASH_BITS = 7, 56

#: Signs of a sketch, and standard deviations by which two may differ in more of them than the threshold's angle makes likely.
SKETCH, DEVIATIONS = 256, 6.0

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def padded_width(d: int) -> int:
    """Components after padding with zeros; short vectors get room, or their rotations would be few."""
    return 1 << max(6, (d - 1).bit_length())


@lru_cache(64)
def chance(d: int, hashes: int, probes: int, cosine: float) -> float:
    """The chance that two vectors of d components at this cosine meet in a table, from random pairs."""
    rng = np.random.default_rng(11)
    n, tables = 384, 8
    x, z = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if d > 1:
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z
    else:
        y = x
    a, b = (codes(v, tables, hashes, probes, seed=77).reshape(n, tables, probes) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))
    # One half is taken off the hits, so that a chance is not thought larger than it is.
    return max(0.0, (met.sum() - 0.5) / met.size)


def plan(d: int, count: int, probes: int = PROBES, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(hashes of a table, tables) for `count` vectors of d components."""
    hashes = max(1, math.ceil(math.log(SPARSE * max(count, 1)) / math.log(2 * padded_width(d))))
    while True:
        p = chance(d, hashes, probes, cosine)
        tables = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p)) if p > 0 else MAX_TABLES + 1
        if tables <= MAX_TABLES or hashes == 1:
            return hashes, min(tables, (1 << TABLE_BITS) - 1)
        hashes -= 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two), orthonormal, by factors of up to 16."""
    n, shape = x.shape[-1], x.shape
    left = n
    y = x.reshape(-1, n)
    while left > 1:
        f = min(16, left)
        # The last factor's axis is transformed and goes to the front; after all of them the axes are in order again.
        y = (y.reshape(-1, f) @ _small_hadamard(f)).reshape(-1, n // f, f).transpose(0, 2, 1).reshape(-1, n)
        left //= f
    return y.reshape(shape)


@lru_cache(8)
def _small_hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]]) / math.sqrt(2)
    return h


def codes(units: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 5) -> np.ndarray:
    """(vectors, tables * probes) bucket numbers of unit vectors; the first of each table is the vector's own."""
    n, d = units.shape
    width = padded_width(d)
    padded = np.zeros((n, width))
    padded[:, :d] = units
    rng = np.random.default_rng(seed + width)
    signs = rng.choice([-1.0, 1.0], (tables, hashes, 3, width))
    rows = np.arange(n)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        best, loss, second = np.empty((n, hashes), np.int64), np.empty((n, hashes)), np.empty((n, hashes), np.int64)
        for h in range(hashes):
            y = padded
            for k in range(3):
                y = hadamard(y * signs[t, h, k])
            size = np.abs(y)
            first = size.argmax(axis=1)
            top = size[rows, first]
            best[:, h] = 2 * first + (y[rows, first] < 0)
            size[rows, first] = -1.0
            other = size.argmax(axis=1)
            second[:, h] = 2 * other + (y[rows, other] < 0)
            loss[:, h] = top - size[rows, other]
        # Which hashes take their second axis: the sets of least total loss, the empty one first.
        masks = np.array([[m >> h & 1 for h in range(hashes)] for m in range(1 << hashes)], bool)
        cost = (loss[:, None, :] * masks[None]).sum(2)
        chosen = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        axes = np.where(masks[chosen], second[:, None, :], best[:, None, :])
        # Vectors of other lengths never meet.
        with np.errstate(over="ignore"):
            acc = np.full(axes.shape[:2], d, np.uint64)
            for h in range(hashes):
                acc = _mix(acc * _STEP + axes[:, :, h].astype(np.uint64))
        own = (acc >> np.uint64(64 - HASH_BITS)).astype(np.int64) | t << HASH_BITS
        out[:, t, : own.shape[1]] = own
        out[:, t, own.shape[1] :] = own[:, :1]
    return out.reshape(n, -1)


def _vectors(batch):
    """(ids, list of float64 vectors or None) of a batch (id, vector)."""
    ok = []
    for v in batch.column(1):
        x = None
        if v.is_valid and len(v) and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
        ok.append(x)
    return ok


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def _kinds(batches):
    """(id, vector) -> (vec_id, class, width): equal usable vectors have one class."""
    for b in batches:
        vectors = _vectors(b)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array([None if v is None else xxhash.xxh3_128_digest((v + 0.0).tobytes()) for v in vectors], pa.binary()), pa.array([0 if v is None else len(v) for v in vectors], pa.int32())],
            names=["vec_id", "class", "width"],
        )


def _stored(v: np.ndarray) -> bytes:
    """A vector's bytes, in single precision where that loses nothing; the last byte tells."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return single.tobytes() + b"4" if (single == v).all() else v.tobytes() + b"8"


def _units(column) -> np.ndarray:
    """Unit vectors of stored ones of equal length."""
    out = []
    for x in column:
        raw = x.as_buffer()
        kind = np.float32 if len(raw) % 4 == 1 and memoryview(raw)[-1] == 52 else np.float64
        out.append(_unit(np.frombuffer(raw, kind, (len(raw) - 1) // np.dtype(kind).itemsize).astype(np.float64)))
    return np.stack(out)


def _classed(batches):
    """(id, vector) -> (class, stored vector) of the usable ones."""
    for b in batches:
        vectors = [v for v in _vectors(b) if v is not None]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest((v + 0.0).tobytes()) for v in vectors], pa.binary()), pa.array([_stored(v) for v in vectors], pa.binary())], names=["class", "vector"])


@lru_cache(8)
def _projections(d: int) -> np.ndarray:
    return np.random.default_rng(1009 + d).normal(size=(d, SKETCH))


def sketches(units: np.ndarray) -> np.ndarray:
    """(vectors, SKETCH / 64) of signs as bits."""
    return np.packbits(units @ _projections(units.shape[1]) > 0, axis=1).view(np.uint64)


def most_apart(cosine: float) -> int:
    """Signs in which two vectors at this cosine, or closer, differ at most."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


def _hashed(plans, probes):
    """(key, vector, width) -> with codes, sketch and buckets; plans: width -> (hashes, tables)."""

    def run(batches):
        for b in batches:
            width = b.column(2).to_numpy()
            short, signs, buckets = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for d in np.unique(width).tolist():
                at = np.flatnonzero(width == d)
                hashes, tables = plans[d]
                units = _units(b.column(1).take(pa.array(at)))
                for i, c, sign in zip(at.tolist(), codes(units, tables, hashes, probes), sketches(units), strict=True):
                    signs[i] = sign.tobytes()
                    short[i] = c.tobytes()
                    buckets[i] = np.unique(c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(short, pa.binary()), pa.array(signs, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["key", "vector", "width", "codes", "sketch", "buckets"])

    return run


def _local_groups(linked: np.ndarray) -> np.ndarray:
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _fresh(ci, cj, bucket, probes):
    """Whether no smaller bucket is shared, for rows of codes of pairs that share `bucket`."""
    fresh = np.ones(len(ci), bool)
    for t in range(int((bucket >> HASH_BITS).max(initial=-1)) + 1):
        at = slice(t * probes, (t + 1) * probes)
        for a in ci[:, at].T:
            before = a < bucket
            for b in cj[:, at].T:
                fresh &= ~((a == b) & before)
    return fresh


def _codes(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in column])


def _large(g, probes, cosine):
    """(classes, ids, links, smallest id of the group) of one block."""
    side = g.column("side").to_numpy()
    order = np.lexsort((g.column("rep").to_numpy(), side))
    g, side = g.take(order), side[order]
    key, rep, mult = (g.column(k).to_numpy() for k in ("key", "rep", "mult"))
    x, c = _units(g.column("vector")), _codes(g.column("codes"))
    bucket, same = g.column("bucket")[0].as_py(), g.column("bi")[0].as_py() == g.column("bj")[0].as_py()
    linked = x @ x.T >= cosine
    linked &= ~np.eye(len(x), dtype=bool) if same else side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(linked))
    n = np.zeros(len(x))
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        fresh = _fresh(c[a], c[b], np.full(len(a), bucket), probes)
        n += np.bincount(a[fresh], mult[b[fresh]], len(x)) + np.bincount(b[fresh], mult[a[fresh]], len(x))
    hit = linked.any(axis=1)
    low = np.full(len(x), np.iinfo(np.int64).max)
    group = _local_groups(linked)
    np.minimum.at(low, group, rep)
    return key[hit], rep[hit], n[hit], low[group][hit]


def _small(t, starts, sizes, probes, cosine):
    """The same for many blocks of a few rows: their pairs are formed at once, and a link is told where it is first met."""
    key, rep, mult, side, bucket = (t.column(k).to_numpy() for k in ("key", "rep", "mult", "side", "bucket"))
    same = t.column("bi").to_numpy() == t.column("bj").to_numpy()
    x, codes = _units(t.column("vector")), _codes(t.column("codes"))
    first, second = [], []
    for s in np.unique(sizes).tolist():
        a, b = np.triu_indices(s, 1)
        at = starts[sizes == s][:, None]
        first.append((at + a).ravel())
        second.append((at + b).ravel())
    first, second = np.concatenate(first), np.concatenate(second)
    keep = same[first] | (side[first] != side[second])
    first, second = first[keep], second[keep]
    out = []
    for at in range(0, len(first), PAIRS):
        i, j = first[at : at + PAIRS], second[at : at + PAIRS]
        linked = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        i, j = i[linked], j[linked]
        fresh = _fresh(codes[i], codes[j], bucket[i], probes) if len(i) else np.empty(0, bool)
        i, j = i[fresh], j[fresh]
        low = np.minimum(rep[i], rep[j])
        out += [(key[i], rep[i], mult[j], low), (key[j], rep[j], mult[i], low)]
    return [np.concatenate([o[k] for o in out]) for k in range(4)] if out else [np.empty(0)] * 4


def _likely(most):
    """Blocks (bucket, bi, bj, side, key, sketch) -> the rows with a partner that may be similar, without the sketch."""

    def run(batches):
        for t, bounds in sorted_runs(batches):
            sizes = np.diff(bounds)
            side = t.column("side").to_numpy()
            same = t.column("bi").to_numpy() == t.column("bj").to_numpy()
            bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            hit = np.zeros(t.num_rows, bool)

            def meet(first, second):
                keep = same[first] | (side[first] != side[second])
                first, second = first[keep], second[keep]
                near = np.bitwise_count(bits[first] ^ bits[second]).sum(1) <= most
                hit[first[near]] = True
                hit[second[near]] = True

            for s in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
                a, b = np.triu_indices(s, 1)
                starts = bounds[:-1][sizes == s]
                step = max(1, PAIRS // len(a))
                for at in range(0, len(starts), step):
                    some = starts[at : at + step, None]
                    meet((some + a).ravel(), (some + b).ravel())
            for k in np.flatnonzero(sizes > SMALL).tolist():
                rows = np.arange(bounds[k], bounds[k + 1])
                for i in range(len(rows) - 1):
                    meet(np.repeat(rows[i], len(rows) - i - 1), rows[i + 1 :])
            if hit.any():
                yield from t.select(["bucket", "bi", "bj", "side", "key"]).filter(pa.array(hit)).to_batches()

    return run


def _verified(probes, cosine):
    """Blocks (bucket, bi, bj, side, key, rep, mult, vector, width, codes) -> (key, id, n, to): links counted here, and the smallest id of the group."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in range(4)], names=["key", "id", "n", "to"])

    def run(batches):
        for t, bounds in sorted_runs(batches):
            sizes, found = np.diff(bounds), []
            # Vectors of other lengths never share a bucket: a block has one length, and blocks of one length are verified together.
            width = np.fromiter((len(t.column("codes")[int(i)].as_buffer()) << 32 | t.column("width")[int(i)].as_py() for i in bounds[:-1]), np.int64, len(sizes))
            few = (sizes <= SMALL) & (sizes > 1)
            for w in np.unique(width[few]).tolist():
                mine = few & (width == w)
                rows = np.concatenate([np.arange(a, b) for a, b in zip(bounds[:-1][mine].tolist(), bounds[1:][mine].tolist(), strict=True)])
                found.append(_small(t.take(rows), np.cumsum(sizes[mine]) - sizes[mine], sizes[mine], probes, cosine))
            for k in np.flatnonzero(sizes > SMALL):
                found.append(_large(t.slice(bounds[k], sizes[k]), probes, cosine))
            if found:
                yield batch(found)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = PROBES, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing. Equal vectors are one class that counts by its number
    of rows. Vectors of other lengths do not compare. Rows without an id link
    with nothing and have no component. Rows that repeat an id are one vertex
    of the components, each with its own links. Ties: the smallest id stands
    for a component. Other columns are not read. A bucket of any size is
    cut into pairs of blocks. Empty table: empty result. `recall`: share of
    the pairs at the threshold that is to be found; closer pairs are found more
    surely.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    kinds = cut(rows.mapInArrow(lean(_kinds), "vec_id long, class binary, width int"))
    named = kinds.filter("class is not null and vec_id is not null")
    # A class has a key of its own, as an id may come with several vectors; such rows are one vertex.
    classes = cut(named.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.max("width").alias("width")).withColumn("key", F.monotonically_increasing_id()))
    # Lengths are few in any table of embeddings; what comes here is a count for each.
    plans = {r["width"]: plan(r["width"], r["n"], probes, cosine, recall) for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The vector of a class is that of its representative.
    reps = rows.join(classes.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "vector")
    stored = reps.mapInArrow(lean(_classed), "class binary, vector binary").dropDuplicates(["class"])
    hashed = cut(classes.select("key", "class", "width").join(stored, "class").select("key", "vector", "width").mapInArrow(lean(_hashed(plans, probes)), "key long, vector binary, width int, codes binary, sketch binary, buckets array<long>"))
    entries = hashed.select("key", F.explode("buckets").alias("bucket"))
    # Buckets with the same members are one: the smallest, which is also the first that its pairs share.
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("members"), F.min("key").alias("low")).filter("n > 1")
    once = sizes.groupBy("n", "members", "low").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    # A large bucket is cut by the keys' hash; its number of rows says into how many blocks.
    cutup = entries.join(once, "bucket").withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("bi"), F.greatest(k, F.col("block")).alias("bj")))
    placed = cutup.withColumn("pair", F.explode(pair)).select("key", "bucket", "pair.bi", "pair.bj", F.col("block").alias("side"))
    sketched = placed.join(hashed.select("key", "sketch"), "key").select("bucket", "bi", "bj", "side", "key", "sketch")
    met = sketched.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj").mapInArrow(lean(_likely(most_apart(cosine))), "bucket long, bi int, bj int, side int, key long")
    full = met.join(hashed.select("key", "vector", "width", "codes"), "key").join(classes.select("key", "rep", "mult"), "key").select("bucket", "bi", "bj", "side", "key", "rep", "mult", "vector", "width", "codes")
    dealt = full.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    found = cut(dealt.mapInArrow(lean(_verified(probes, cosine)), "key long, id long, n long, to long"))
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    grouped = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    of_class = classes.select("class", "key", "rep", "mult").join(links, "key", "left").join(grouped.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select("class", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    # Vectors that link with nothing stay where they are.
    some = named.join(of_class, "class").select("vec_id", "n_links", "component_id")
    rest = kinds.filter("class is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = some.unionByName(rest)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
