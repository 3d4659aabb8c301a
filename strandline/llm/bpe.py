"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A text is split into pre-tokens ("words"). The ids of a word depend on the word
alone, so each distinct word is encoded once, wherever it occurs. Words that
are frequent in a bounded sample of the documents are encoded first and
broadcast; a document becomes the sequence of its words' places in their list,
with gaps at all other words. Those are exploded with their positions and
shuffled by word, so that equal ones meet and are encoded once; their ids
travel back to the documents and fill the gaps in order. Which words the sample
finds decides what is shuffled, never what comes out. Decoding joins ids with
the table of token bytes, which has a row for each id of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import lean, release_memory

#: Fixed value: how byte-level vocabularies split text, with white space written out (\s of `regex` and of the vocabulary's library agree on it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts whose characters `re` and `regex` class alike, which `re` splits faster.
PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")

#: Words that are broadcast, at most; the longest of them in characters; documents that are asked for them, about.
HOT_WORDS, HOT_LENGTH, HOT_SAMPLE = 3 << 17, 64, 32_768
#: Bytes of a word beyond which its pairs are kept in a heap.
LONG = 128
SALTS = 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Splitter:
    """Pre-tokens of a text by a pattern; by `re` where that gives the same."""

    def __init__(self, pattern: str = PATTERN):
        self.slow = regex.compile(pattern)
        self.plain = pattern == PATTERN

    def __call__(self, text: str) -> list[str]:
        if self.plain and not NOT_PLAIN.search(text):
            return PLAIN.findall(text)
        return self.slow.findall(text)


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: of all neighbouring parts the pair of the lowest rank is merged, the leftmost of equal ones, until no pair is a token."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + 1
    get = ranks.get
    order = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while order:
        low = min(order)
        if low == none:
            break
        i = order.index(low)
        parts[i] += parts.pop(i + 1)
        del order[i]
        if i < len(order):
            order[i] = get(parts[i] + parts[i + 1], none)
        if i:
            order[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over linked parts, in O(n log n)."""
    n = len(word)
    end = list(range(1, n + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    gone = bytearray(n + 1)
    while heap:
        _, i, upto = heapq.heappop(heap)
        j = after[i] if not gone[i] else n
        if j >= n or end[j] != upto:
            continue
        gone[j] = 1
        end[i], after[i] = end[j], after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def _kind(ranks: dict[bytes, int]):
    """Number type of ids on the way."""
    return np.dtype("<u2") if max(ranks.values(), default=0) <= 0xFFFF else np.dtype("<u4")


def place_code(n: int) -> bytes:
    """A number in groups of seven bits, the low ones first; the last byte is below 128. 0 is a gap."""
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def places_of(codes: bytes) -> np.ndarray:
    """The numbers of a sequence of `place_code`."""
    b = np.frombuffer(codes, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = (b[starts] & 127).astype(np.int64)
    for k in range(1, int((ends - starts).max(initial=0)) + 1):
        some = np.flatnonzero(ends - starts >= k)
        out[some] |= (b[starts[some] + k] & 127).astype(np.int64) << 7 * k
    return out


def hot_words(docs: DataFrame, ranks, pattern: str = PATTERN, text_col: str = "text", sample: int = HOT_SAMPLE, words: int = HOT_WORDS) -> tuple[list[str], list[bytes]]:
    """The most frequent words of up to HOT_LENGTH characters in about `sample` documents (chosen by their text's hash), most frequent first, and their ids as bytes.

    Bounded: `words` entries of a bounded length.
    """
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    step = max(1, texts.count() // sample)
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)

    def counted(batches):
        split, seen = Splitter(pattern), {}
        for b in batches:
            for text in b.column(0):
                for w in split(text.as_py()):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > words:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    most = some.mapInArrow(lean(counted), "word string, n long").filter(F.length("word") <= HOT_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    known = docs.sparkSession.sparkContext.broadcast(ranks)
    found = most.mapInArrow(lean(_ids_of_words(known, _kind(ranks))), "word string, n long, ids binary").toArrow()
    found = found.take(pc.sort_indices(found, [("n", "descending"), ("word", "ascending")]))
    return found.column("word").to_pylist(), found.column("ids").to_pylist()


def _ids_of_words(known, kind):
    def run(batches):
        ranks = known.value
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(encode_word(w.encode(), ranks), kind).tobytes() for w in words], pa.binary())], names=["word", "n", "ids"])

    return run


def _key(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", sample: int = HOT_SAMPLE, words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) for each row of `docs`.

    ranks: token bytes -> id; all 256 single bytes are among them. A null or
    empty text has no ids. A null id stays null. Rows that repeat an id and a
    text are repeated; rows that repeat an id with other texts are rows of
    their own. Other columns are not read, so their names cannot clash. Empty
    table: empty result. A word of any length is encoded whole, in O(n log n).
    """
    spark = docs.sparkSession
    kind = _kind(ranks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names, given = hot_words(rows, ranks, pattern, "text", sample, words)
    hot = spark.sparkContext.broadcast({w: place_code(n) for n, w in enumerate(names, 1)})
    # The ids of word n are flat[begin[n] : begin[n + 1]]; a gap, 0, has none.
    begin = np.cumsum([0, 0, *(len(x) // kind.itemsize for x in given)])
    table = spark.sparkContext.broadcast((begin, np.frombuffer(b"".join(given), kind)))
    del names, given
    release_memory()
    # Where ids are unique they alone tell documents apart; else so do id and text.
    unique = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty()
    key_of = (lambda text: 0) if unique else _key
    known = spark.sparkContext.broadcast(ranks)

    def gapped(batches):
        split, get, pack = Splitter(pattern), hot.value.get, zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            keys, codes = [], []
            for text in b.column(1).to_pylist():
                keys.append(key_of(text))
                codes.append(pack(b"".join(map(get, split(text), repeat(b"\0")))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(np.full(len(keys), -1, np.int32)), pa.array(codes, pa.binary())], names=["doc_id", "key", "pos", "ids"])

    def exploded(batches):
        split, known_to_all = Splitter(pattern), hot.value.__contains__
        for b in batches:
            ids, keys, pos, found = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rare = list(filterfalse(known_to_all, split(text)))
                if rare:
                    ids += [doc] * len(rare)
                    keys += [key_of(text)] * len(rare)
                    pos += range(len(rare))
                    found += rare
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(pos, pa.int32()), pa.array(found, pa.string())], names=["doc_id", "key", "pos", "word"])

    def encoded(batches):
        """Rows sorted by word: a run of equal words is encoded once."""
        ranks, last, own = known.value, None, b""
        for b in batches:
            out = []
            for w in b.column(3).to_pylist():
                if w != last:
                    last, own = w, np.array(encode_word(w.encode(), ranks), kind).tobytes()
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["doc_id", "key", "pos", "ids"])

    def filled(batches):
        """Rows sorted by document and position: its words (as often as the row is repeated), then the ids of those that are gaps."""
        begin, flat = table.value
        unpack = zstandard.ZstdDecompressor().decompress
        now, times, codes, rare, at = None, 0, b"", [], -1

        def whole():
            place = places_of(unpack(codes))
            sizes = begin[place + 1] - begin[place]
            first = begin[place]
            if rare:
                gaps = np.flatnonzero(place == 0)
                sizes[gaps] = [len(r) // kind.itemsize for r in rare]
                first[gaps] = len(flat) + np.cumsum(sizes[gaps]) - sizes[gaps]
            ends = np.cumsum(sizes)
            at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
            if rare:
                other = np.frombuffer(b"".join(rare), kind)
                inside = at < len(flat)
                out = np.empty(len(at), kind)
                out[inside] = flat[at[inside]]
                out[~inside] = other[at[~inside] - len(flat)]
                return out
            return flat[at]

        def batch(done):
            lengths = [len(x) for _, x in done]
            values = pa.array(np.concatenate([x for _, x in done]).astype(np.int32) if done else np.empty(0, np.int32))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), values)
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.int64()), listed], names=["doc_id", "ids"])

        done, load = [], 0
        for b in batches:
            for doc, key, pos, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (doc, key) != now:
                    if now is not None:
                        x = whole()
                        for _ in range(times):
                            done.append((now[0], x))
                            load += len(x)
                            if load > 1 << 20:
                                yield batch(done)
                                done, load = [], 0
                    now, times, rare, at = (doc, key), 0, [], -1
                if pos < 0:
                    codes = own
                    times += 1
                elif pos != at:
                    rare.append(own)
                    at = pos
        if now is not None:
            x = whole()
            for _ in range(times):
                done.append((now[0], x))
                if len(done) * len(x) > 1 << 20:
                    yield batch(done)
                    done = []
        yield batch(done)

    row = "doc_id long, key long, pos int, {}"
    rare = rows.mapInArrow(lean(exploded), row.format("word string"))
    # Equal words meet. What the sample has missed may still be frequent: a word has up to SALTS places.
    met = rare.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS))).repartition("word", "salt").sortWithinPartitions("word").select("doc_id", "key", "pos", "word")
    back = met.mapInArrow(lean(encoded), row.format("ids binary")).unionByName(rows.mapInArrow(lean(gapped), row.format("ids binary")))
    return back.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "pos").mapInArrow(lean(filled), "doc_id long, ids array<int>")


class TokenBytes:
    """The table of token bytes, one after another, joined to ids by their number."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values(), default=-1) + 1
        table: list[bytes] = [b""] * n
        self.size = np.full(n, -1, np.int32)
        for token, i in ranks.items():
            table[i], self.size[i] = token, len(token)
        self.begin = (np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)).astype(np.int32)
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any():
            raise ValueError("an id that the vocabulary lacks")
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[ids] - (ends - size), size)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) for each row (doc_id, ids): the token-byte table joined to the ids, in their order.

    Null or empty ids: no bytes. An id that the vocabulary lacks raises.
    Repeated rows are repeated; other columns are not read. Empty table: empty
    result. The table is broadcast: it has one short row for each id.
    """
    known = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        table = TokenBytes(known.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([table(x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)) for x in b.column(1)], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(lean(run), "doc_id long, bytes binary")


def digest_encoding(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids): the ids as little-endian unsigned 32-bit integers, and what they decode to."""
    known = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        table = TokenBytes(known.value)
        for b in batches:
            n, ids, decoded = [], [], []
            for x in b.column(1):
                own = x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)
                n.append(len(own))
                ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(table(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
