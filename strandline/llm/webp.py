"""Lossless WebP (VP8L): a full decoder to pixel arrays, and an encoder for byte payloads.

The decoder reads prefix codes, backward references, the colour cache, groups
of codes, and undoes the predictor, cross-colour, subtract-green and palette
transforms. Where only the green code carries information, as in palette
images, it decodes without a loop over pixels: the code that begins at each
bit is looked up for all bits at once, and the chain of codes is followed by
doubled jumps.

The encoder stores a payload as a grey image, one byte a pixel. Repeats become
backward references, and few different bytes become a palette with several
pixels in one. Text has no smoothness that another transform could use, so
each of the others is dealt to a sixteenth of the images by the payload's
checksum: predictor, cross-colour, subtract-green, and two bytes a pixel with
a colour cache. Reading a corpus back undoes every part of the format, and
equal payloads have equal media.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import lean

MAX_SIDE = 1 << 14
#: Fixed values of the format: the order of code length codes, and alphabet sizes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES, MAX_BITS = 256, 24, 40, 15
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The 120 near pixels that short distance codes stand for, nearest first: (left, up).
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


#: Every number of 15 bits with its bits in reverse order.
REVERSED = sum((np.arange(1 << MAX_BITS) >> k & 1) << (MAX_BITS - 1 - k) for k in range(MAX_BITS))


class Corrupt(ValueError):
    """The bytes are not a lossless WebP image."""


#: Windows (25 bits from each bit on) that a reader loads for codes and for pixels; zeros after the end.
HEADER, WINDOWS, PAST = 1 << 11, 1 << 16, 256


def windows(data: bytes, first: int, count: int) -> np.ndarray:
    """The 25 bits and more from each bit of `count` bytes on, beginning at byte `first`; zeros after the end."""
    raw = np.frombuffer(data, np.uint8, max(0, min(count + 3, len(data) - first)), min(first, len(data)))
    raw = np.concatenate((raw, np.zeros(count + 3 - len(raw), np.uint8))).astype(np.uint32)
    word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    return (word[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)


class Bits:
    """Reads little-endian bit fields of up to 25 bits."""

    def __init__(self, data: bytes):
        self.data, self.pos, self.end = data, 0, len(data) * 8
        self.base, self.view = 0, []

    def room(self, n: int) -> int:
        """Load windows so that the next n bits have theirs, or all that are left; the place of `pos` among them."""
        if self.pos - self.base + n > len(self.view) and self.base + len(self.view) < self.end + PAST:
            first = self.pos >> 3
            self.base = first << 3
            self.view = windows(self.data, first, min((max(n, HEADER) >> 3) + 8, max(0, len(self.data) - first) + (PAST >> 3))).tolist()
        return self.pos - self.base

    def read(self, n: int) -> int:
        if self.pos + n > self.end:
            raise Corrupt("the data end early")
        at = self.room(32)
        out = self.view[at] & ((1 << n) - 1)
        self.pos += n
        return out


@cache
def reversal(n: int) -> np.ndarray:
    """All numbers of n bits with their bits in reverse order."""
    return REVERSED[: 1 << n] >> (MAX_BITS - n)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical code words."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used):
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order].astype(np.int64)
        longest = int(n[-1])
        # In order of length each word begins where the words before it end.
        place = np.cumsum(1 << (longest - n)) - (1 << (longest - n))
        out[order] = REVERSED[place >> (longest - n)] >> (MAX_BITS - n)
    return out


class Code:
    """A prefix code as a table over the next `bits` bits: length << 16 | symbol. A single symbol takes no bits."""

    def __init__(self, lengths: np.ndarray | None, single: int = 0):
        self.table, self.bits = None, 0
        if lengths is not None:
            used = np.flatnonzero(lengths)
            single = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        self.single, self.last = single, single
        if single is not None:
            self.rows = [single]
            return
        self.last = int(used[-1])
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order].astype(np.int64)
        self.bits = int(n[-1])
        share = 1 << (self.bits - n)
        if share.sum() != 1 << self.bits:
            raise Corrupt("a prefix code is not complete")
        self.table = np.repeat((n << 16 | order).astype(np.int32), share)[reversal(self.bits)]
        self.rows = self.table.tolist()

    def at(self, view: np.ndarray) -> np.ndarray:
        """length << 16 | symbol for many windows."""
        return np.full(len(view), self.single, np.int32) if self.table is None else self.table.take((view & np.uint32((1 << self.bits) - 1)).astype(np.intp), mode="clip")


@lru_cache(64)
def _code_of(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.int64))


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        second = bits.read(8) if two else first
        if max(first, second) >= alphabet:
            raise Corrupt("a symbol is outside its alphabet")
        if first == second:
            return Code(None, first)
        lengths = np.zeros(alphabet, np.int64)
        lengths[[first, second]] = 1
        return Code(lengths)
    lengths = np.zeros(alphabet, np.int64)
    of_lengths = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = _code_of(of_lengths.tobytes())
    room = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if room > alphabet:
        raise Corrupt("too many code lengths")
    # A code that ends later than this loads more.
    here = bits.room(HEADER)
    view, rows, mask = bits.view, code.rows, (1 << code.bits) - 1
    at, last, p, found = 0, 8, here, []
    while at < alphabet and room:
        room -= 1
        if p + 32 > len(view):
            bits.pos += p - here
            here = p = bits.room(HEADER)
            view = bits.view
        e = rows[view[p] & mask]
        p += e >> 16
        n = e & 0xFFFF
        if n < 16:
            if n:
                found.append((at, n))
                last = n
            at += 1
            continue
        if n == 16:
            times = 3 + (view[p] & 3)
            p += 2
            found += [(at + i, last) for i in range(times)]
        elif n == 17:
            times = 3 + (view[p] & 7)
            p += 3
        else:
            times = 11 + (view[p] & 127)
            p += 7
        at += times
        if at > alphabet:
            raise Corrupt("code lengths run over")
    bits.pos += p - here
    if bits.pos > bits.end:
        raise Corrupt("the data end early")
    for at, n in found:
        lengths[at] = n
    return Code(lengths)


def _extra(symbol: int) -> tuple[int, int]:
    """(extra bits, offset) of a length or distance prefix."""
    if symbol < 4:
        return 0, symbol
    n = (symbol - 2) >> 1
    return n, (2 + (symbol & 1)) << n


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Codes are followed 2^JUMPS at a time, in images from AT_ONCE pixels on.
JUMPS, AT_ONCE = 5, 256


def _grey(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    """Green samples of an image whose other channels are constant; no colour cache, one group."""
    first = bits.pos >> 3
    view = windows(bits.data, first, len(bits.data) - first + 5)
    here = codes[0].at(view)
    size, symbol = here >> 16, here & 0xFFFF
    if codes[0].table is None:
        if codes[0].single >= LITERALS:
            raise Corrupt("a copy begins before the image")
        return np.full(total, codes[0].single, np.uint8)
    n = len(view)
    step = size.copy()
    run = back = None
    # A code without copies needs no look at what each bit could begin.
    copies = np.flatnonzero(symbol >= LITERALS) if codes[0].last >= LITERALS else ()
    if len(copies):
        at = copies + size[copies]

        def field(at, k):
            at = np.minimum(at, n - 1)
            return (view[at] & ((np.uint32(1) << k.astype(np.uint32)) - np.uint32(1))).astype(np.int64)

        def prefixed(at, s):
            k = np.where(s < 4, 0, (s - 2) >> 1)
            return at + k, np.where(s < 4, s, (2 + (s & 1)) << k) + field(at, k) + 1

        at, length = prefixed(at, symbol[copies].astype(np.int64) - LITERALS)
        d = codes[4].at(view[np.minimum(at, n - 1)]).astype(np.int64)
        at, far = prefixed(at + (d >> 16), d & 0xFFFF)
        step[copies] = at - copies
        run = np.ones(n, np.int32)
        run[copies] = np.minimum(length, 1 << 20)
        back = np.zeros(n, np.int64)
        back[copies] = far
    stop = n - 1
    step = step + np.arange(n)
    jumps, made = [np.minimum(step, stop, out=step)], run
    for _ in range(JUMPS):
        j = jumps[-1]
        if made is not None:
            made = made + made.take(j, mode="clip")
        jumps.append(j.take(j, mode="clip"))
    far_jump = jumps[JUMPS]
    p, have, starts = bits.pos & 7, 0, []
    while have < total:
        starts.append(p)
        have += (1 << JUMPS) if made is None else int(made[p])
        q = int(far_jump[p])
        if q == stop and have < total:
            raise Corrupt("the data end early")
        p = q
    chain = np.array(starts)
    for k in reversed(range(JUMPS)):
        chain = np.stack((chain, jumps[k].take(chain, mode="clip")), axis=1).reshape(-1)
    jump = jumps[0]
    if run is None:
        chain = chain[:total]
        bits.pos = (bits.pos & ~7) + int(jump[chain[-1]])
        return symbol[chain].astype(np.uint8)
    counts = run[chain]
    upto = np.cumsum(counts)
    used = int(np.searchsorted(upto, total)) + 1
    chain, counts, upto = chain[:used], counts[:used], upto[:used]
    if upto[-1] != total:
        raise Corrupt("a copy runs over the image")
    bits.pos = (bits.pos & ~7) + int(jump[chain[-1]])
    value = symbol[chain]
    if not (value >= LITERALS).any():
        return value.astype(np.uint8)
    out = np.empty(total, np.uint8)
    literal = value < LITERALS
    out[(upto - counts)[literal]] = value[literal]
    for i in np.flatnonzero(~literal):
        begin, end, distance = int(upto[i] - counts[i]), int(upto[i]), _distance(int(back[chain[i]]), width)
        if distance > begin:
            raise Corrupt("a copy begins before the image")
        while begin < end:  # what is copied may overlap itself
            m = min(end - begin, distance)
            out[begin : begin + m] = out[begin - distance : begin - distance + m]
            begin, distance = begin + m, distance + m if m == distance else distance
    return out


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, (height, width) uint32."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Corrupt("the colour cache is too large")
    groups, meta, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = read_pixels(bits, -(-width >> shift), -(-height >> shift), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sets = [[read_code(bits, a) for a in (LITERALS + LENGTHS + cache_size, LITERALS, LITERALS, LITERALS, DISTANCES)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_size and all(c.single is not None for c in sets[0][1:4]):
        rest = sets[0][3].single << 24 | sets[0][1].single << 16 | sets[0][2].single
        if sets[0][0].table is None and sets[0][0].single < LITERALS:
            return np.full((height, width), rest | sets[0][0].single << 8, np.uint32)
        if total >= AT_ONCE:
            return (np.uint32(rest) | _grey(bits, sets[0], width, total).astype(np.uint32) << np.uint32(8)).reshape(height, width)
    tables = [tuple(x for c in codes for x in (c.rows, (1 << c.bits) - 1)) for codes in sets]
    out, seen, at, drop = [0] * total, [0] * cache_size, 0, 32 - cache_bits
    t0, m0, t1, m1, t2, m2, t3, m3, t4, m4 = tables[0]
    copies = LITERALS + LENGTHS
    # Nothing is read for constant channels.
    red, flat = groups > 1 or m1 > 0, groups == 1 and not m2 and not m3
    rest = (0 if red else t1[0] << 16) | (t3[0] << 24 | t2[0] if flat else 0)
    p, view, limit = 0, (), -1
    try:
        while at < total:
            if p > limit:
                bits.pos = bits.base + p if view else bits.pos
                p = bits.room(WINDOWS)
                view = bits.view
                limit = len(view) - 96 if bits.base + len(view) < bits.end + PAST else len(view)
            if meta is not None:
                t0, m0, t1, m1, t2, m2, t3, m3, t4, m4 = tables[int(meta[(at // width) >> shift, (at % width) >> shift])]
            e = t0[view[p] & m0]
            p += e >> 16
            s = e & 0xFFFF
            if s < LITERALS:
                c = s << 8 | rest
                if red:
                    e = t1[view[p] & m1]
                    p += e >> 16
                    c |= (e & 0xFF) << 16
                if not flat:
                    e = t2[view[p] & m2]
                    p += e >> 16
                    c |= e & 0xFF
                    e = t3[view[p] & m3]
                    p += e >> 16
                    c |= (e & 0xFF) << 24
            elif s >= copies:
                # What the cache gives is already in its place.
                out[at] = seen[s - copies]
                at += 1
                continue
            else:
                k, offset = _extra(s - LITERALS)
                length = offset + (view[p] & ((1 << k) - 1)) + 1
                p += k
                e = t4[view[p] & m4]
                p += e >> 16
                k, offset = _extra(e & 0xFFFF)
                distance = _distance(offset + (view[p] & ((1 << k) - 1)) + 1, width)
                p += k
                if distance > at or at + length > total:
                    raise Corrupt("a copy leaves the image")
                fresh = out[at - distance : at - distance + min(length, distance)]
                fresh = (fresh * (length // len(fresh) + 1))[:length]
                out[at : at + length] = fresh
                at += length
                if cache_size:
                    for c in fresh:
                        seen[(0x1E35A7BD * c & 0xFFFFFFFF) >> drop] = c
                continue
            out[at] = c
            at += 1
            if cache_size:
                seen[(0x1E35A7BD * c & 0xFFFFFFFF) >> drop] = c
    except IndexError:
        raise Corrupt("the data end early") from None
    bits.pos = bits.base + p
    if bits.pos > bits.end:
        raise Corrupt("the data end early")
    return np.array(out, np.uint32).reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(h, w, 4) of int: alpha, red, green, blue."""
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & np.uint32(0xFF)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left, top, top_left, top_right):
    """The predicted channels of one pixel, from arrays of 4."""
    half = lambda a, b: (a + b) // 2
    clamp = lambda x: np.clip(x, 0, 255)
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return half(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        guess = left + top - top_left
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return clamp(left + top - top_left)
    if mode == 13:
        mean = half(left, top)
        # The format rounds this half towards zero.
        return clamp(mean + ((mean - top_left) / 2).astype(np.int64))
    return np.array([255, 0, 0, 0])


#: Modes that need no pixel of their own row but the first, or only a running sum of it.
ROW_MODES = (0, 1, 2, 3, 4, 8, 9)


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = pixels.shape
    mode = (modes >> 8 & 0xF).tolist()
    whole = [m[0] if len(set(m)) == 1 and m[0] in ROW_MODES and width > 1 else -1 for m in mode]
    residual = _channels(pixels)
    residual[0, 0, 0] = residual[0, 0, 0] + 255 & 255
    # Without residuals a channel is its first pixel, but for alpha under mode 0, which is not taken from a neighbour.
    still = [] if min(whole) < 1 else [k for k in range(4) if np.count_nonzero(residual[..., k]) == (residual[0, 0, k] != 0)]
    vary = [k for k in range(4) if k not in still]
    if not vary:
        return np.full((height, width), _packed(residual[0, 0]))
    out = residual[..., vary] if still else residual
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above, m = out[y], out[y - 1], whole[y >> shift]
        row[0] += above[0]
        if m >= 0:
            if m == 1:
                np.cumsum(row, axis=0, out=row)
            elif m == 0:
                row[0] &= 255
                row[1:, 0] += 255
            elif m == 2 or m == 4:
                row[1:] += above[1:] if m == 2 else above[:-1]
            elif m == 8:
                row[1:] += (above[:-1] + above[1:]) >> 1
            else:
                row[0] &= 255
                right = np.concatenate((above[2:], row[:1]))
                row[1:] += right if m == 3 else (above[1:] + right) >> 1
            row &= 255
            continue
        row[0] &= 255
        of_row = mode[y >> shift]
        right = np.concatenate((above[1:], row[:1]))
        for x in range(1, width):
            row[x] = (row[x] + predict(of_row[x >> shift], row[x - 1], above[x], above[x - 1], right[x])) & 255
    if still:
        residual[..., vary] = out
        residual[..., still] = residual[0, 0, still]
        out = residual
    return _packed(out)


def undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, shift: int) -> np.ndarray:
    c = _channels(pixels)
    height, width = pixels.shape
    f = np.repeat(np.repeat(_channels(factors), 1 << shift, axis=0)[:height], 1 << shift, axis=1)[:, :width]
    signed = lambda x: (x + 128 & 255) - 128
    delta = lambda t, x: signed(t) * signed(x) >> 5
    red = c[..., 1] + delta(f[..., 3], c[..., 2]) & 255
    c[..., 3] = c[..., 3] + delta(f[..., 2], c[..., 2]) + delta(f[..., 1], red) & 255
    c[..., 1] = red
    return _packed(c)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(0xFF)
    return pixels & np.uint32(0xFF00FF00) | (pixels & np.uint32(0xFF00FF)) + (green << np.uint32(16) | green) & np.uint32(0xFF00FF)


def undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    index = (pixels >> np.uint32(8) & np.uint32(0xFF)).astype(np.int64)
    bits = _pixel_bits(len(palette))
    if bits < 8:
        per = 8 // bits
        index = (index[:, :, None] >> (np.arange(per) * bits) & ((1 << bits) - 1)).reshape(len(index), -1)[:, :width]
    return np.concatenate((palette, np.zeros(256, np.uint32)))[index]


def _pixel_bits(colours: int) -> int:
    return 1 if colours <= 2 else 2 if colours <= 4 else 4 if colours <= 16 else 8


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file as ARGB numbers, (height, width) uint32."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise Corrupt("no lossless WebP header")
    size = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + size or data[20] != 0x2F:
        raise Corrupt("the data end early")
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Corrupt("unknown version")
    undo, stored, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Corrupt("a transform is used twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            extra = read_pixels(bits, -(-stored >> shift), -(-height >> shift), False)
            undo.append(lambda p, e=extra, s=shift, k=kind: (undo_predictor if k == PREDICTOR else undo_cross_colour)(p, e, s))
        elif kind == SUBTRACT_GREEN:
            undo.append(undo_subtract_green)
        else:
            colours = bits.read(8) + 1
            steps = _channels(read_pixels(bits, colours, 1, False))[0]
            palette = _packed(np.cumsum(steps, axis=0))
            undo.append(lambda p, c=palette, w=stored: undo_palette(p, c, w))
            stored = -(-stored // (8 // _pixel_bits(colours)))
    pixels = read_pixels(bits, stored, height, True)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels


def images(media: bytes) -> list[np.ndarray]:
    """All images of a medium: files one after another."""
    out, at = [], 0
    while at < len(media) or not out:
        size = int.from_bytes(media[at + 4 : at + 8], "little") + 8
        out.append(decode(media[at : at + size]))
        at += size
    return out


def samples(found: list[np.ndarray]) -> bytes:
    """The bytes of the pixels: green and red in images of PAIRS columns, green in all others."""
    return b"".join((x >> np.uint32(8)).astype("<u2" if x.shape[1] == PAIRS else np.uint8).tobytes() for x in found)


def packed_bits(values: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int]:
    """(bytes, number of bits) of little-endian fields of up to 33 bits."""
    total = np.cumsum(sizes)
    if not len(total) or not total[-1]:
        return b"", 0
    at = (total - sizes).astype(np.uint64)
    place, shifted = (at >> np.uint64(5)).astype(np.int64), values.astype(np.uint64) << (at & np.uint64(31))
    words = (int(total[-1]) + 31) // 32 + 1
    # Fields share no bit, so sums are unions; sums below 2^53 are exact.
    low = np.bincount(place, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    high = np.bincount(place + 1, (shifted >> np.uint64(32)).astype(np.float64), words + 1)
    return (low + high[:words]).astype(np.uint32).tobytes()[: (int(total[-1]) + 7) // 8], int(total[-1])


class Writer:
    """Collects bit fields and writes them little-endian."""

    def __init__(self):
        self.parts, self.values, self.sizes = [], [], []

    def put(self, value: int, n: int):
        self.values.append(value)
        self.sizes.append(n)

    def fields(self, values: np.ndarray, sizes: np.ndarray):
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []
        self.parts.append((values, sizes))

    def bytes(self) -> tuple[bytes, int]:
        self.fields(np.empty(0, np.int64), np.empty(0, np.int64))
        return packed_bits(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))

    def array(self) -> np.ndarray:
        data, n = self.bytes()
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Huffman code lengths of at most `limit` bits."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    weight = counts[used].astype(np.int64)
    n = len(used)
    while True:
        # The two lightest are joined again and again: leaves and joints both come by rising weight.
        order = np.argsort(weight, kind="stable")
        leaves = weight[order].tolist()
        leaves += [1 << 62, 1 << 62]
        joints, parent = [1 << 62] * (n + 1), [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):
            if leaves[i] <= joints[j]:
                total = leaves[i]
                parent[i] = n + k
                i += 1
            else:
                total = joints[j]
                parent[n + j] = n + k
                j += 1
            if leaves[i] <= joints[j]:
                total += leaves[i]
                parent[i] = n + k
                i += 1
            else:
                total += joints[j]
                parent[n + j] = n + k
                j += 1
            joints[k] = total
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if depth[0] <= limit:
            out[used[order]] = depth[:n]
            return out
        weight = weight // 2 + 1


def put_single(w: Writer, symbol: int) -> None:
    w.put(5 | symbol << 3, 11)


def put_code(w: Writer, lengths: np.ndarray) -> None:
    """Write a prefix code: in the short form when it has no more than two symbols below 256."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < LITERALS):
        symbols = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in symbols:
            w.put(s, 8)
        return
    # Before each used symbol, and at the end, come zeros: one or two spelled out, or one or more runs.
    last = np.concatenate(([-1], used))
    zeros = np.concatenate((used, [len(lengths)])) - last - 1
    runs = np.where(zeros < 3, zeros, -(-zeros // 138))
    which = np.repeat(np.arange(len(zeros)), runs + 1)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(runs + 1) - runs - 1, runs + 1)
    left = zeros[which] - nth * 138
    own = nth == runs[which]
    few, short = zeros[which] < 3, left < 11
    token = np.where(own, np.append(lengths[used], 0)[which], np.where(few, 0, np.where(short, 17, 18)))
    extra = np.where(own | few, 0, np.where(short, left - 3, np.minimum(left, 138) - 11))
    more = np.where(own | few, 0, np.where(short, 3, 7))
    # A rest of one or two zeros after a full run is spelled as such.
    tail = ~own & ~few & (left < 3)
    token[tail], extra[tail], more[tail] = 0, 0, 0
    again = np.flatnonzero(tail & (left == 2))
    if len(again):
        token, extra, more = np.insert(token, again, 0), np.insert(extra, again, 0), np.insert(more, again, 0)
        token, extra, more = token[:-1], extra[:-1], more[:-1]
    else:
        token, extra, more = token[:-1], extra[:-1], more[:-1]
    # Lengths up to 13 have a code of four bits for each of 16 symbols; longer ones one of their own.
    of_lengths = FOUR_BITS if int(lengths.max()) <= 13 else code_lengths(np.bincount(token, minlength=19), 7)
    words = FOUR_WORDS if of_lengths is FOUR_BITS else canonical(of_lengths)
    present = max(max(i for i, s in enumerate(LENGTH_ORDER) if of_lengths[s]) + 1, 4)
    w.put(present - 4 << 1, 5)
    for s in LENGTH_ORDER[:present]:
        w.put(int(of_lengths[s]), 3)
    w.put(0, 1)
    w.fields(words[token] | extra << of_lengths[token], of_lengths[token] + more)


FOUR_BITS = np.array([4] * 14 + [0] * 3 + [4] * 2)
FOUR_WORDS = canonical(FOUR_BITS)


def _prefix(value: np.ndarray):
    """(symbol, extra bits, extra value) of lengths or distances (1 and up)."""
    v = value - 1
    k = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2, 0)
    small = v < 4
    k = np.where(small, 0, k)
    return np.where(small, v, 2 * k + 2 + (v >> k & 1)), k, v & ((1 << k) - 1)


def container(bits: np.ndarray) -> bytes:
    """A file of these bits."""
    return file_of(np.packbits(bits, bitorder="little").tobytes())


def file_of(data: bytes) -> bytes:
    body = b"\x2f" + data
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (len(padded) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


#: Pixels of a row of 64 bytes, with one byte and with two bytes a pixel; bytes that one image holds at most.
WIDTH, PAIRS, IMAGE_BYTES = 64, 32, 1 << 20
#: Shortest copy in bytes, longest one in pixels, and how far back it may reach; copies are used where they cover one in COPIED pixels.
LEAST_COPY, MOST_COPY, FARTHEST, COPIED = 12, 4096, (1 << 20) - 120, 16
#: Of so many images without a palette one has the predictor, one cross-colour, one subtract-green and one the cache.
DEALT = 16
#: Sides of a tile of predictor modes and of cross-colour factors, as powers of two.
PREDICTOR_SHIFT, CROSS_SHIFT = 6, 6
#: Modes that the encoder tries.
TRIED = (1, 2, 3, 4, 8, 9)


@cache
def near_codes(width: int) -> np.ndarray:
    """The short code of each near distance, 0: none."""
    out = np.zeros(8 * width + 16, np.int64)
    for i in range(len(NEAR), 0, -1):
        out[_distance(i, width)] = i
    return out


def by_key(key: np.ndarray) -> np.ndarray:
    """Places by key (32 bits), then place."""
    both = key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def repeats(key: np.ndarray, window: int, least: int):
    """(starts, lengths, distances) of copies of `least` pixels and more, in order and apart; key: what the next `window` pixels are.

    A copy is a stretch whose windows were all last seen at one distance.
    """
    none = np.empty(0, np.int64)
    if len(key) < 2:
        return none, none, none
    order = by_key(key)
    one, two = order[:-1], order[1:]
    again = key[one] == key[two]
    back = np.zeros(len(key) + 2, np.int64)
    back[two[again] + 1] = (two - one)[again]
    back[back > FARTHEST] = 0
    edge = back[1:] != back[:-1]
    head = np.flatnonzero(edge[:-1] & (back[1:-1] != 0))
    if not len(head):
        return none, none, none
    end = np.flatnonzero(edge[1:] & (back[1:-1] != 0)) + window
    distance = back[head + 1]
    start = np.maximum(head, np.concatenate(([0], end[:-1])))
    good = end - start >= least
    start, end, distance = start[good], end[good], distance[good]
    if len(start) and (end - start).max() > MOST_COPY:
        pieces = -(-(end - start) // MOST_COPY)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end, distance = (np.repeat(x, pieces) for x in (start, end, distance))
        start = start + nth * MOST_COPY
    return start, np.minimum(end - start, MOST_COPY), distance


def entropy(counts: np.ndarray) -> float:
    """Bits of all symbols together."""
    c = counts[counts > 0]
    return float(c.sum() * np.log2(c.sum()) - (c * np.log2(c)).sum()) if len(c) > 1 else 0.0


def recent(px: np.ndarray, literal: np.ndarray, bits: int):
    """(cache places, whether the place holds the pixel) with a cache of 2^bits colours."""
    place = px * np.uint32(0x1E35A7BD) >> np.uint32(32 - bits)
    order = by_key(place)
    one, two = order[:-1], order[1:]
    hit = np.zeros(len(px), bool)
    hit[two] = (place[one] == place[two]) & (px[one] == px[two])
    return place.astype(np.int64), hit & literal


def put_image(w: Writer, px: np.ndarray, width: int, main: bool) -> None:
    """An entropy-coded image of ARGB numbers."""
    n = len(px)
    if n == 1 or not (px != px[0]).any():
        # One colour: every code has a single symbol, and pixels take no bits.
        w.put(0, 2 if main else 1)
        for shift in (8, 16, 0, 24):
            put_single(w, int(px[0]) >> shift & 0xFF)
        put_single(w, 0)
        return
    varies = int(np.bitwise_or.reduce(px ^ px[0]))
    channels = [(px >> np.uint32(s) & np.uint32(0xFF)).astype(np.int64) if not k or varies >> s & 0xFF else int(px[0]) >> s & 0xFF for k, s in enumerate((8, 16, 0, 24))]
    start = length = distance = np.empty(0, np.int64)
    if main and not varies & 0xFF0000FF:
        # Four bytes are a key: of as many grey pixels, or of two pixels of two bytes.
        low = channels[0].astype(np.uint32)
        if isinstance(channels[1], int):
            key = low[:-3] | low[1:-2] << np.uint32(8) | low[2:-1] << np.uint32(16) | low[3:] << np.uint32(24)
            start, length, distance = repeats(key, 4, LEAST_COPY)
        else:
            both = low | channels[1].astype(np.uint32) << np.uint32(8)
            start, length, distance = repeats(both[:-1] | both[1:] << np.uint32(16), 2, LEAST_COPY // 2)
        if length.sum() * COPIED < n:
            start = length = distance = np.empty(0, np.int64)
    literal = np.ones(n, bool)
    first = literal
    if len(start):
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + length, -1)
        literal = np.cumsum(step[:-1]) == 0
        first = literal.copy()
        first[start] = True
    symbol, cache_bits, hit = channels[0], 0, None
    # A cache saves nothing where a pixel is a single symbol.
    if main and n >= 32 and varies & 0xFFFF00FF:
        bits = min(10, n.bit_length() - 2)
        place, hit = recent(px, literal, bits)
        each = sum(entropy(np.bincount(c[literal])) for c in channels if not isinstance(c, int)) / max(1, literal.sum())
        shown = np.bincount(place[hit], minlength=1)
        # A hit costs its index and a bit that tells it from literals; each index in use costs a code length.
        if hit.sum() * (each - 1) > entropy(shown) + 5 * np.count_nonzero(shown):
            cache_bits, symbol = bits, np.where(hit, LITERALS + LENGTHS + place, symbol)
        else:
            hit = None
    if len(start):
        codes = near_codes(width)
        code = np.where(distance < len(codes), codes[np.minimum(distance, len(codes) - 1)], 0)
        long_symbol, long_bits, long_extra = _prefix(length)
        far_symbol, far_bits, far_extra = _prefix(np.where(code > 0, code, distance + len(NEAR)))
        symbol = symbol.copy()
        symbol[start] = LITERALS + long_symbol
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)  # one group of codes
    spelled = literal if hit is None else literal & ~hit
    green = np.bincount(symbol[first], minlength=LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0))
    far = np.bincount(far_symbol, minlength=DISTANCES) if len(start) else 0
    limit = 12 if n <= 1 << 13 else MAX_BITS
    # Two fields a pixel: green and red, or a copy's length; blue and alpha, or its distance.
    values, sizes = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
    every = bool(spelled.all())
    for k, count in enumerate((green, *(c if isinstance(c, int) else np.bincount(c if every else c[spelled], minlength=LITERALS) for c in channels[1:]), far)):
        if isinstance(count, int):
            put_single(w, count)
            continue
        top = int(count.argmax())
        if top < LITERALS and np.count_nonzero(count) == 1:
            put_single(w, top)
            continue
        lengths = code_lengths(count, limit)
        put_code(w, lengths)
        if np.count_nonzero(lengths) < 2:
            continue
        words, side = canonical(lengths), k >> 1
        if k == 4:
            values[start, 1] = words[far_symbol] | far_extra << lengths[far_symbol]
            sizes[start, 1] = lengths[far_symbol] + far_bits
            continue
        own = first if k == 0 else spelled
        of = (symbol if k == 0 else channels[k])[own]
        values[own, side] |= words[of] << sizes[own, side]
        sizes[own, side] += lengths[of]
    if len(start):
        values[start, 0] |= long_extra << sizes[start, 0]
        sizes[start, 0] += long_bits
        if np.count_nonzero(far) < 2:
            values[start, 1], sizes[start, 1] = far_extra, far_bits
    if not sizes[:, 1].any():
        values, sizes = values[:, 0], sizes[:, 0]
    w.fields(values.reshape(-1), sizes.reshape(-1))


def put_predictor(w: Writer, c: np.ndarray) -> np.ndarray:
    """Write the predictor modes of the tiles, those of least absolute residuals; the residuals of channels c."""
    height, width, _ = c.shape
    # A constant channel is predicted by any mode but at the first pixel.
    vary = [k for k in range(4) if (c[..., k] != c[0, 0, k]).any()]
    out = np.zeros_like(c)
    out[0, 0] = c[0, 0] - (255, 0, 0, 0) & 255
    c = c[..., vary]
    n = len(vary)
    left = np.concatenate((np.zeros((height, 1, n), np.int32), c[:, :-1]), axis=1)
    top = np.concatenate((np.zeros((1, width, n), np.int32), c[:-1]))
    corner = np.concatenate((np.zeros((height, 1, n), np.int32), top[:, :-1]), axis=1)
    right = np.concatenate((top[:, 1:], c[:, :1]), axis=1)
    guesses = np.stack([{1: left, 2: top, 3: right, 4: corner, 8: corner + top >> 1, 9: top + right >> 1}[m] for m in TRIED])
    guesses[:, 0], guesses[:, 1:, 0] = left[0], top[1:, 0]
    guesses[:, 0, 0] = np.array((255, 0, 0, 0))[vary]
    residual = c - guesses & 255
    cost = np.abs((residual + 128 & 255) - 128).sum(axis=3)
    side = np.arange(0, height, 1 << PREDICTOR_SHIFT), np.arange(0, width, 1 << PREDICTOR_SHIFT)
    tiles = np.add.reduceat(np.add.reduceat(cost, side[0], axis=1), side[1], axis=2).argmin(axis=0)
    w.put(1, 1)
    w.put(PREDICTOR, 2)
    w.put(PREDICTOR_SHIFT - 2, 3)
    put_image(w, np.array(TRIED, np.uint32)[tiles].reshape(-1) << np.uint32(8), tiles.shape[1], False)
    of = np.repeat(np.repeat(tiles, 1 << PREDICTOR_SHIFT, axis=0)[:height], 1 << PREDICTOR_SHIFT, axis=1)[:, :width]
    out[..., vary] = np.take_along_axis(residual, of[None, :, :, None], axis=0)[0]
    return out


def put_cross_colour(w: Writer, c: np.ndarray) -> np.ndarray:
    """Write the cross-colour factors of the tiles, those of least squares; the residuals of channels c."""
    height, width, _ = c.shape
    signed = (c + 128 & 255) - 128
    side = np.arange(0, height, 1 << CROSS_SHIFT), np.arange(0, width, 1 << CROSS_SHIFT)
    added = lambda a: np.add.reduceat(np.add.reduceat(signed[..., a] * signed[..., 2], side[0], axis=0), side[1], axis=1)
    of = lambda over, under: np.clip(np.round(32 * over / np.maximum(under, 1)), -128, 127).astype(np.int32)
    own = added(2)
    to_red, to_blue = of(added(1), own), of(added(3), own)
    w.put(1, 1)
    w.put(CROSS_COLOUR, 2)
    w.put(CROSS_SHIFT - 2, 3)
    put_image(w, _packed(np.stack([np.full_like(own, 255), np.zeros_like(own), to_blue, to_red], axis=-1)).reshape(-1), own.shape[1], False)
    grown = lambda x: np.repeat(np.repeat(x, 1 << CROSS_SHIFT, axis=0)[:height], 1 << CROSS_SHIFT, axis=1)[:, :width]
    out = c.copy()
    out[..., 1] -= grown(to_red) * signed[..., 2] >> 5
    out[..., 3] -= grown(to_blue) * signed[..., 2] >> 5
    return out & 255


def put_palette(w: Writer, colours: np.ndarray, index: np.ndarray, height: int) -> tuple[np.ndarray, int]:
    """Write the colours; (pixels that hold the indices, several each where there are few colours, and pixels of a row)."""
    steps = _channels(colours)
    steps[1:] -= _channels(colours)[:-1]
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(colours) - 1, 8)
    put_image(w, _packed(steps), len(colours), False)
    bits = _pixel_bits(len(colours))
    per = 8 // bits
    packed = (index.reshape(height, WIDTH // per, per) << (np.arange(per) * bits)).sum(axis=2)
    return packed.reshape(-1).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), WIDTH // per


def encode_image(data: bytes) -> bytes:
    """Up to IMAGE_BYTES bytes, a multiple of 64, as one image."""
    grey = np.frombuffer(data, np.uint8).astype(np.uint32)
    height, width = len(grey) // WIDTH, WIDTH
    colours = np.flatnonzero(np.bincount(grey, minlength=256))
    dealt = zlib.crc32(data) % DEALT if len(colours) > 16 else None
    px = grey << np.uint32(8) | np.uint32(0xFF000000)
    if dealt == 3:
        width = PAIRS
        px = np.frombuffer(data, "<u2").astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    elif dealt in (1, 2):
        px |= grey | grey << np.uint32(16)
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    if dealt is None:
        px, width = put_palette(w, colours.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), np.searchsorted(colours, grey), height)
    elif dealt == 0:
        px = _packed(put_predictor(w, _channels(px).reshape(height, width, 4))).reshape(-1)
    elif dealt == 1:
        px = _packed(put_cross_colour(w, _channels(px).reshape(height, width, 4))).reshape(-1)
    elif dealt == 2:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        px &= np.uint32(0xFF00FF00)
    w.put(0, 1)
    put_image(w, px, width, True)
    return file_of(w.bytes()[0])


def encode_bytes(payload: bytes) -> bytes:
    """A payload, a positive multiple of 64 bytes, as images one after another, each a file of its own."""
    return b"".join(encode_image(payload[at : at + IMAGE_BYTES]) for at in range(0, len(payload), IMAGE_BYTES))


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64)


def feature(data: bytes, found: list[np.ndarray]) -> str:
    """Shape of the images, and what their samples are like."""
    x = np.frombuffer(data, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / max(len(x), 1)
    bits = abs(float(-(p * np.log2(p)).sum()))
    # Sums of whole numbers, so that no order of adding shows.
    values = np.arange(256)
    n = max(len(x), 1)
    mean = int((counts * values).sum()) / n
    spread = max(int((counts * values * values).sum()) / n - mean * mean, 0.0) ** 0.5
    return f"{found[0].shape[1]}x{sum(len(f) for f in found)};images={len(found)};mean={mean:.4f};std={spread:.4f};entropy={bits:.4f};distinct={len(p)};top={int(counts.argmax())}"


def store_as_webp(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): each text as a lossless WebP image of its bytes.

    Null and empty texts give one row of 64 zero bytes. Equal texts give equal
    media; repeated rows are repeated; other columns are not read. Empty table:
    empty result. No shuffle.
    """

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            payloads = [payload_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(map(len, payloads), pa.int64()), pa.array([encode_bytes(p) for p in payloads], pa.binary())],
                names=["doc_id", "n_bytes", "payload_bytes", "media"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, media binary")


def read_webp(df: DataFrame, media_col: str = "media", size_col: str | None = "payload_bytes") -> DataFrame:
    """`df` without the media, with what they decode to: width, height, pixels, feature.

    pixels: the green samples row by row, or green and red in images of 32
    columns; a medium may be several images, which follow one another. `size_col`: bytes
    that are payload (the images may have more). A null medium, or bytes that
    are no lossless WebP, give nulls. Columns named width, height, pixels or
    feature are replaced. Repeated rows are repeated. Empty table: empty result.
    """
    rest = [c for c in df.columns if c not in (media_col, "width", "height", "pixels", "feature")]
    shaped = df.select(*rest, media_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shaped.schema.fields[: len(rest)]), "width int, height int, pixels binary, feature string"])
    at = rest.index(size_col) if size_col else None

    def run(batches):
        for b in batches:
            sizes = b.column(at).to_pylist() if at is not None else [None] * b.num_rows
            out = []
            for x, n in zip(b.column(len(rest)), sizes, strict=True):
                try:
                    found = images(x.as_py()) if x.is_valid else None
                except Corrupt:
                    found = None
                if found is None:
                    out.append((None, None, None, None))
                    continue
                data = samples(found)[:n]
                out.append((found[0].shape[1], sum(len(f) for f in found), data, feature(data, found)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string())))], names=[*rest, "width", "height", "pixels", "feature"])

    return shaped.mapInArrow(lean(run), schema)


def digest_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and return digests of both; media and pixels do not leave the pass.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature). Null and empty texts are 64 zero bytes. A long text
    is stored as several images, so memory is bounded by the text itself. Equal
    texts have equal values; repeated rows are repeated; a null id stays null;
    other columns are not read. Empty table: empty result.
    """

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1):
                payload = payload_of(t.as_py())
                media = encode_bytes(payload)
                found = images(media)
                back = samples(found)
                out.append((len((t.as_py() or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, found)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
