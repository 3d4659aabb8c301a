import numpy as np
import pytest

from strandline.llm import webp as W
from tests.llm.cases import frame, rows

RNG = np.random.default_rng(5)


def pixels(h, w, colours=None):
    p = RNG.integers(0, 2**32, (h, w), dtype=np.uint64).astype(np.uint32)
    return p if colours is None else RNG.choice(np.unique(p)[:colours], (h, w)).astype(np.uint32)


class Stream:
    """A general writer: literals, copies and cache hits with one code set for each group."""

    def __init__(self, width, height):
        self.w = W.Writer()
        self.w.put(width - 1, 14)
        self.w.put(height - 1, 14)
        self.w.put(1, 1)
        self.w.put(0, 3)

    def image(self, p, main, cache_bits=0, copies=False, meta=None, shift=2):
        w, flat = self.w, [int(x) for x in p.reshape(-1)]
        width = p.shape[1]
        w.put(1 if cache_bits else 0, 1)
        if cache_bits:
            w.put(cache_bits, 4)
        if main:
            w.put(0 if meta is None else 1, 1)
            if meta is not None:
                w.put(shift - 2, 3)
                self.image((meta.astype(np.uint32) << np.uint32(8)), False)
        groups = 1 if meta is None else int(meta.max()) + 1
        tokens, cache, at = [], {}, 0
        while at < len(flat):
            length = distance = 0
            if copies:
                for d in (1, width, width + 1, 2 * width + 3, 150):
                    n = 0
                    while d <= at and at + n < len(flat) and flat[at + n] == flat[at + n - d] and n < 300:
                        n += 1
                    if n > length:
                        length, distance = n, d
            if length >= 2:
                near = next((i + 1 for i, (x, y) in enumerate(W.NEAR) if max(1, x + y * width) == distance), None)
                tokens.append((at, "copy", length, near or distance + len(W.NEAR)))
                fresh = flat[at : at + length]
            else:
                key = (0x1E35A7BD * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
                tokens.append((at, "cache", key, 0) if cache_bits and cache.get(key) == flat[at] else (at, "pixel", flat[at], 0))
                fresh = flat[at : at + 1]
            for c in fresh:
                if cache_bits:
                    cache[(0x1E35A7BD * c & 0xFFFFFFFF) >> (32 - cache_bits)] = c
            at += len(fresh)
        fields = []
        for at, kind, a, b in tokens:
            g = 0 if meta is None else int(meta[(at // width) >> shift, (at % width) >> shift])
            if kind == "pixel":
                fields.append((g, [(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)], []))
            elif kind == "cache":
                fields.append((g, [(0, 280 + a)], []))
            else:
                (s1, k1, x1), (s2, k2, x2) = (tuple(int(v[0]) for v in W._prefix(np.array([n]))) for n in (a, b))
                fields.append((g, [(0, 256 + s1), (4, s2)], [(x1, k1), (x2, k2)]))
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        codes = []
        for g in range(groups):
            lengths = [W.code_lengths(np.bincount([s for gg, f, _ in fields if gg == g for c, s in f if c == channel] or [0], minlength=n)) for channel, n in enumerate(sizes)]
            for n in lengths:
                W.put_code(w, n)
            codes.append([(n, W.canonical(n)) for n in lengths])
        for g, parts, extra in fields:
            for k, (channel, s) in enumerate(parts):
                n, word = codes[g][channel]
                if np.count_nonzero(n) > 1:
                    w.put(int(word[s]), int(n[s]))
                if extra:
                    w.put(*extra[k])
        return self

    def transform(self, kind):
        self.w.put(1, 1)
        self.w.put(kind, 2)
        return self

    def end(self):
        self.w.put(0, 1)
        return self

    def file(self):
        return W.container(self.w.array())


@pytest.mark.parametrize("options", [{}, {"cache_bits": 1}, {"cache_bits": 6}, {"copies": True}, {"copies": True, "cache_bits": 11}])
@pytest.mark.parametrize("colours", [None, 1, 2, 30])
def test_plain_images(options, colours):
    p = pixels(13, 21, colours)
    if colours == 30:
        p[5:9] = p[1:5]
        p[2, 3:20] = p[2, 3]
    assert (W.decode(Stream(21, 13).end().image(p, True, **options).file()) == p).all()


def test_groups_of_codes():
    p = pixels(18, 22, 9)
    meta = RNG.integers(0, 3, (5, 6))
    assert (W.decode(Stream(22, 18).end().image(p, True, meta=meta, copies=True).file()) == p).all()


def test_predictor_modes():
    p = pixels(40, 37)
    modes = np.arange(100).reshape(10, 10)[:, : -(-37 // 4)] % 14
    c = W._channels(p)
    residual = np.zeros_like(c)
    for y in range(40):
        for x in range(37):
            if y == 0:
                guess = np.array([255, 0, 0, 0]) if x == 0 else c[0, x - 1]
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < 37 else c[y, 0]
                guess = W.predict(int(modes[y >> 2, x >> 2]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], right)
            residual[y, x] = c[y, x] - guess & 255
    s = Stream(37, 40).transform(W.PREDICTOR)
    s.w.put(0, 3)
    s.image(modes.astype(np.uint32) << np.uint32(8), False).end().image(W._packed(residual), True)
    assert (W.decode(s.file()) == p).all()


@pytest.mark.parametrize("mode", [1, 2])
def test_fast_predictor_rows(mode):
    p = pixels(9, 11)
    c = W._channels(p)
    residual = c.copy()
    residual[0, 0, 0] -= 255
    residual[0, 1:] -= c[0, :-1]
    residual[1:, 0] -= c[:-1, 0]
    residual[1:, 1:] -= c[1:, :-1] if mode == 1 else c[:-1, 1:]
    modes = np.full((3, 3), mode << 8, np.uint32)
    assert (W.undo_predictor(W._packed(residual), modes, 2) == p).all()


def test_predictions_by_hand():
    a = lambda *v: np.array(v)
    left, top, tl, tr = a(10, 20, 30, 40), a(20, 30, 40, 51), a(5, 0, 255, 40), a(1, 2, 3, 4)
    got = {m: W.predict(m, left, top, tl, tr).tolist() for m in range(14)}
    assert got[0] == [255, 0, 0, 0] and got[5] == [12, 20, 28, 36] and got[7] == [15, 25, 35, 45]
    assert got[10] == [8, 13, 81, 33] and got[12] == [25, 50, 0, 51]
    # Half of the distance of the mean from the corner, towards zero, is added to the mean.
    assert got[13] == [20, 37, 0, 47]
    assert got[11] == (left if abs(25 - 10) + abs(50 - 20) + abs(-185 - 30) + abs(51 - 40) < abs(25 - 20) + abs(50 - 30) + abs(-185 - 40) + 0 else top).tolist()


def test_cross_colour_and_subtract_green():
    p = pixels(12, 10)
    f = pixels(3, 3)
    c = W._channels(p)
    t = np.repeat(np.repeat(W._channels(f), 4, axis=0)[:12], 4, axis=1)[:, :10]
    signed = lambda x: (x + 128) % 256 - 128
    stored = c.copy()
    stored[..., 1] = c[..., 1] - (signed(t[..., 3]) * signed(c[..., 2]) >> 5) & 255
    stored[..., 3] = c[..., 3] - (signed(t[..., 2]) * signed(c[..., 2]) >> 5) - (signed(t[..., 1]) * signed(c[..., 1]) >> 5) & 255
    s = Stream(10, 12).transform(W.CROSS_COLOUR)
    s.w.put(0, 3)
    s.image(f, False).transform(W.SUBTRACT_GREEN)
    green = W._channels(W._packed(stored))
    green[..., 1] -= green[..., 2]
    green[..., 3] -= green[..., 2]
    s.end().image(W._packed(green), True)
    assert (W.decode(s.file()) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    table = np.unique(pixels(20, 20))[:colours]
    index = RNG.integers(0, len(table), (7, 19))
    bits = W._pixel_bits(len(table))
    per = 8 // bits
    packed = np.zeros((7, -(-19 // per)), np.uint32)
    for x in range(19):
        packed[:, x // per] |= (index[:, x] << (bits * (x % per))).astype(np.uint32)
    steps = W._channels(table[None])[0]
    steps[1:] -= W._channels(table[None])[0][:-1]
    s = Stream(19, 7).transform(W.PALETTE)
    s.w.put(len(table) - 1, 8)
    s.image(W._packed(steps)[None], False).end().image(packed << np.uint32(8) | np.uint32(0xFF000000), True, copies=True)
    assert (W.decode(s.file()) == table[index]).all()


def test_all_transforms_together():
    table = np.unique(pixels(9, 9))[:5]
    index = RNG.integers(0, 5, (10, 12)).astype(np.uint32)
    packed = np.zeros((10, 6), np.uint32)
    for x in range(12):
        packed[:, x // 2] |= index[:, x] << np.uint32(4 * (x % 2))
    stored = packed << np.uint32(8) | np.uint32(0xFF000000)
    steps = W._channels(table[None])[0]
    steps[1:] -= W._channels(table[None])[0][:-1]
    s = Stream(12, 10).transform(W.PALETTE)
    s.w.put(4, 8)
    s.image(W._packed(steps)[None], False)
    c = W._channels(stored)
    residual = c.copy()
    residual[0, 0, 0] -= 255
    residual[0, 1:] -= c[0, :-1]
    residual[1:, 0] -= c[:-1, 0]
    residual[1:, 1:] -= c[1:, :-1]
    s.transform(W.PREDICTOR)
    s.w.put(0, 3)
    s.image(np.full((3, 2), 1 << 8, np.uint32), False).end().image(W._packed(residual), True, cache_bits=4)
    assert (W.decode(s.file()) == table[index]).all()


def stored(payload):
    """What an image reader makes of the stored bytes: green, or green and red, of each pixel."""
    found = W.images(W.encode_bytes(payload))
    assert all((x >> np.uint32(24) == 255).all() for x in found)
    channels = [[x >> np.uint32(8) & np.uint32(255), x >> np.uint32(16) & np.uint32(255)][: 64 // x.shape[1]] for x in found]
    return b"".join(np.stack(c, axis=-1).astype(np.uint8).tobytes() for c in channels)


@pytest.mark.parametrize("text", [None, "", "a", "ab" * 3000, "x" * 100_000, "\0" * 300, "é日\U0001f600" * 50, "".join(chr(i) for i in range(1, 600))])
def test_payload_round_trip(text):
    payload = W.payload_of(text)
    assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == (text or "").encode().rstrip(b"\0")
    assert stored(payload) == payload == W.samples(W.images(W.encode_bytes(payload)))


def test_random_payloads():
    for n in (64, 640, 6400, 64 * 3000):
        for kinds in (1, 2, 3, 17, 256):
            payload = RNG.integers(0, kinds, n).astype(np.uint8)
            payload[n // 3 : n // 2] = 7
            assert stored(payload.tobytes()) == payload.tobytes()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    known = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(120)]
    return " ".join(known[i] for i in rng.integers(0, 120, n))


@pytest.mark.parametrize("width", [1, 2, 7, 32, 64, 130])
def test_any_pixels_through_each_transform(width):
    # The encoder's own transforms on arbitrary channels, not only those of payloads.
    for kind in ("predictor", "cross"):
        c = W._channels(pixels(70, width))
        w = W.Writer()
        residual = (W.put_predictor if kind == "predictor" else W.put_cross_colour)(w, c)
        bits = W.Bits(np.packbits(np.concatenate((w.array(), np.zeros(64, np.uint8))), bitorder="little").tobytes())
        assert bits.read(1) == 1 and bits.read(2) == (W.PREDICTOR if kind == "predictor" else W.CROSS_COLOUR)
        shift = bits.read(3) + 2
        extra = W.read_pixels(bits, -(-width >> shift), -(-70 >> shift), False)
        undo = W.undo_predictor if kind == "predictor" else W.undo_cross_colour
        assert (W._channels(undo(W._packed(residual), extra, shift)) == c).all()


def test_a_corpus_goes_through_every_part_of_the_format(monkeypatch):
    texts = [prose(20 + 9 * i, i) for i in range(150)] + ["no", "", "abc " * 300, "ab" * 40, prose(60, 1) * 3]
    used = {}

    def count(name):
        f = getattr(W, name)

        def counted(*a):
            out = f(*a)
            used[name] = used.get(name, 0) + (name == "undo_palette" or not (out == a[0]).all())
            return out

        monkeypatch.setattr(W, name, counted)

    for name in ("undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_palette"):
        count(name)
    media = [W.encode_bytes(W.payload_of(t)) for t in texts]
    for t, m in zip(texts, media, strict=True):
        assert W.samples(W.images(m)) == W.payload_of(t)
    assert len(used) == 4 and min(used.values()) >= 3
    # Two bytes a pixel, with the cache and copies.
    pairs = [np.frombuffer(W.payload_of(t), "<u2").astype(np.uint32) for t, m in zip(texts, media, strict=True) if W.images(m)[0].shape[1] == W.PAIRS]
    assert len(pairs) > 5 and all(W.recent(p << np.uint32(8), np.ones(len(p), bool), 8)[1].mean() > 0.1 for p in pairs)
    assert sum(len(W.repeats(key_of(W.payload_of(t)), 4, W.LEAST_COPY)[0]) > 0 for t in texts) > 50


def key_of(payload):
    b = np.frombuffer(payload, np.uint8).astype(np.uint32)
    return b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


def test_repeats_are_what_was_before():
    for n, kinds in ((5, 1), (300, 2), (4000, 3), (20000, 1), (3000, 200)):
        b = RNG.integers(0, kinds, n).astype(np.uint8)
        b[n // 2 :] = b[: n - n // 2]
        covered = np.zeros(n, int)
        for s, size, back in zip(*W.repeats(key_of(b.tobytes()), 4, 6), strict=True):
            assert 1 <= back <= s and 1 <= size <= W.MOST_COPY
            covered[s : s + size] += 1
            assert (b[s : s + size] == b[s - back : s - back + size]).all() or back < size
            assert all(b[i] == b[i - back] for i in range(s, s + size))
        assert covered.max(initial=0) <= 1 and (1 < kinds < 200 or n < 100 or covered.sum() > n // 3)


def test_long_payloads_are_several_images():
    payload = W.payload_of(prose(400_000, 3))
    found = W.images(W.encode_bytes(payload))
    assert [len(x) for x in found] == [W.IMAGE_BYTES // 64] * (len(found) - 1) + [len(payload) % W.IMAGE_BYTES // 64] and W.samples(found) == payload


def test_code_headers_round_trip():
    for n in (1, 2, 3, 5, 40, 256, 280, 1304):
        for share in (0.01, 0.2, 1.0):
            counts = RNG.integers(1, 50, n) * (RNG.random(n) < share)
            counts[RNG.integers(0, n)] += 1
            lengths = W.code_lengths(np.concatenate((counts, np.zeros(max(n, 256) - n, np.int64))))
            w = W.Writer()
            W.put_code(w, lengths)
            back = W.read_code(W.Bits(np.packbits(np.concatenate((w.array(), np.zeros(300, np.uint8))), bitorder="little").tobytes()), len(lengths))
            fresh = W.Code(lengths)
            assert back.single == fresh.single and back.rows == fresh.rows


def test_long_codes_are_limited():
    counts = np.array([1 << i for i in range(40)])
    n = W.code_lengths(counts)
    assert n.max() <= 15 and sum(2.0**-n) == 1.0


def test_prefixes_round_trip():
    v = np.arange(1, 5000)
    s, k, x = W._prefix(v)
    assert [W._extra(int(a))[1] + int(c) + 1 for a, c in zip(s, x, strict=True)] == v.tolist()
    assert [W._extra(int(a))[0] for a in s] == k.tolist()


def test_corrupt_data():
    good = W.encode_bytes(W.payload_of("hello world " * 40))
    for bad in (b"", good[:30], b"RIFX" + good[4:], good[:20] + b"\x00" + good[21:], good[: len(good) // 2]):
        with pytest.raises(W.Corrupt):
            W.decode(bad)
    assert len(W.NEAR) == 120 and W.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)]


def test_frames(spark):
    stored = W.store_as_webp(frame(spark))
    back = W.read_webp(stored).collect()
    texts = {r[0]: r[1] for r in rows()}
    assert len(back) == len(rows())
    for r in back:
        assert bytes(r["pixels"]) == W.payload_of(texts[r["doc_id"]])
    got = W.digest_media(frame(spark)).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["payload_bytes"] == 64 and by[4]["media_sha256"] == by[5]["media_sha256"] and by[1]["feature"] == by[2]["feature"]
    assert W.digest_media(frame(spark, True)).count() == 0
    odd = spark.createDataFrame([(1, None, 64), (2, b"nothing", 64)], "doc_id long, media binary, payload_bytes long")
    assert all(r["pixels"] is None for r in W.read_webp(odd).collect())
