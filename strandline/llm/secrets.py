"""Secret scan over recursively decoded layers of a text.

A worklist starts with the text itself. Each layer is scanned, then every
decodable region in it (percent-encoding, \\u and \\x escapes, base64, and
zlib/gzip/bzip2/xz payloads under any of these) yields a further layer, until
nothing new appears. A layer is the decoded region with as much of the text
around it as a finding or a further encoding could take in, not a copy of the
whole text. Layers already seen at a place are not opened again, so cycles
end. A layer keeps the mapping of its characters to its parent, and a finding
is reported once, at the characters of the original text it comes from: by the
first layer that decodes a part of it.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import lean

KINDS = ("assign", "access", "hex")
#: The three patterns and the least lengths that count.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE_MIN, ACCESS_MIN = 6, 20
WORDS = ("token", "password", "passwd", "secret", "apikey", "api_key")

#: An escaped escape sign (%25, \\x5c, \\u005c), escaped again any number of times, is undone in one step: what lies between is the sign and parts of what follows it.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\(?:u005[Cc])*u[0-9A-Fa-f]{4})+")
BYTE_ESCAPE = re.compile(r"(?:\\(?:x5[Cc])*x[0-9A-Fa-f]{2})+")
PERCENT_UNIT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
UNICODE_UNIT = re.compile(r"\\(?:u005[Cc])*u([0-9A-Fa-f]{4})")
BYTE_UNIT = re.compile(r"\\(?:x5[Cc])*x([0-9A-Fa-f]{2})")
#: One token, or lines of one width and a last one that is no longer.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
TOKEN_MIN = 16
#: Text within other bytes, as long as a shortest token holds.
RUN = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: What around a decoded region may be of one finding or one encoding with it, on its right and, in the reversed text, on its left.
AFTER = re.compile(r"""[A-Za-z0-9+/_.=%\\-]*["']?\x20*[:=]?\x20*["']?[A-Za-z0-9+/_.=%\\-]*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_.=%\\-]+)*""")
BEFORE = re.compile(AFTER.pattern.replace(r"\r?\n", r"\n\r?"))
#: Steps after which escapes that keep yielding escapes are undone all at once.
DEEP = 32
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

#: Only decompression makes texts longer, so it alone is bounded. A payload may always grow by this factor; payloads of
#: one text that grow by more share MAX_DECODED bytes. Beyond it a payload is read in part, and `truncated` is set.
EXPANSION, MAX_DECODED = 32, 64 << 20

PLACEHOLDER = "[SECRET]"


def byte_places(text: str):
    """Character -> its first byte in UTF-8, for each one and the end."""
    if text.isascii():
        return lambda i: i
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upto = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
    return lambda i: int(upto[i])


def unit_places(text: str):
    """Character -> its first unit in UTF-16, for each one and the end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upto = np.concatenate(([0], np.cumsum(1 + (code > 0xFFFF))))
    return lambda i: int(upto[i])


class Layer:
    """A text with its parent; `segments`: (from, to, parent from, parent to, how).

    how: 1, the parent's own characters; 0, the region as a whole; or a
    function from a range of the segment's characters to the parent's.
    """

    __slots__ = ("text", "parent", "segments", "starts", "depth", "steps")

    def __init__(self, text, parent=None, segments=(), steps=1):
        self.text, self.parent, self.segments, self.steps = text, parent, segments, steps
        self.starts = [s[0] for s in segments]
        self.depth = parent.depth + 1 if parent else 0

    def decoded(self, start, end):
        """Whether any character of this range was decoded at this layer."""
        i = bisect_right(self.starts, start) - 1
        while i < len(self.segments) and self.segments[i][0] < end:
            if self.segments[i][4] != 1:
                return True
            i += 1
        return False

    def origin(self, start, end):
        layer = self
        while layer.parent is not None:
            lo, _, plo, _, how = layer.segments[bisect_right(layer.starts, start) - 1]
            first = plo + start - lo if how == 1 else how(start - lo, start - lo + 1)[0] if how else plo
            lo, _, plo, phi, how = layer.segments[bisect_right(layer.starts, end - 1) - 1]
            last = plo + end - lo if how == 1 else how(end - 1 - lo, end - lo)[1] if how else phi
            start, end = first, last
            layer = layer.parent
        return start, end


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE_MIN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def members(data: bytes, room: int) -> tuple[bytes, bool]:
    """What all members or streams of one compressed payload hold, up to `room` bytes; what follows them is ignored. True: something was cut."""
    parts, size = [], 0
    while MAGIC.match(data):
        kind = bz2.BZ2Decompressor if data[:3] == b"BZh" else lzma.LZMADecompressor if data[:1] == b"\xfd" else lambda: zlib.decompressobj(47)
        one = kind()
        try:
            out = one.decompress(data, room + 1 - size)
        except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
            break
        parts.append(out)
        size += len(out)
        if size > room:
            return b"".join(parts)[:room], True
        if not one.eof:
            break
        data = one.unused_data.lstrip(b"\0")
    return b"".join(parts), False


def inflate(data: bytes, room: int) -> tuple[bytes, bool]:
    """Undo compression as long as there is any; no more than `room` bytes a step. True: something was cut."""
    seen = set()
    while MAGIC.match(data):
        mark = hashlib.blake2b(data, digest_size=16).digest()
        if mark in seen:
            break
        seen.add(mark)
        out, cut_short = members(data, room)
        if cut_short:
            return out, True
        if not out:
            break
        data = out
    return data, False


def readable(data: bytes, cut_short: bool = False) -> str | None:
    """The bytes as text, if they are text; cut_short: the last character may be incomplete."""
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(data, not cut_short)
    except UnicodeDecodeError:
        return None
    return text if text and len(CONTROL.findall(text)) * 10 <= len(text) else None


def _steps(region: str) -> int:
    """Layers that are undone where a region is decoded: one, and one for each time that the sign of an escape is itself escaped."""
    units = ((PERCENT_UNIT, "%25", 3), (BYTE_UNIT, "\\x5", 4), (UNICODE_UNIT, "\\u005", 6))
    return 1 + max(((m.end() - m.start() - width) // (width - 1) for unit, sign, width in units if sign in region for m in unit.finditer(region)), default=0)


def _layer(parent: Layer, lo: int, hi: int, regions) -> Layer:
    """The parent's text from lo to hi with regions (from, to, text, how) replaced."""
    text, parts, segments, at, pos = parent.text, [], [], lo, 0
    steps = max(_steps(text[start:end]) for start, end, _, _ in regions)
    for start, end, out, how in (*regions, (hi, hi, "", 0)):
        if start > at:
            segments.append((pos, pos + start - at, at, start, 1))
            parts.append(text[at:start])
            pos += start - at
        if out:
            segments.append((pos, pos + len(out), start, end, how))
            parts.append(out)
            pos += len(out)
        at = end
    return Layer("".join(parts), parent, segments, steps)


def _zones(layer: Layer, pattern: re.Pattern, decode):
    """A layer for each zone of the text around regions that `decode` accepts; decode: match -> [(from, to, text, how)], in order."""
    text, back, zone, lo, hi = layer.text, None, [], 0, 0
    for region in (found for m in pattern.finditer(text) for found in decode(m)):
        start, end, _, _ = region
        if start > hi or not zone:
            back = text[::-1] if back is None else back
            # No character is looked at twice: a zone ends where the one before it does.
            left = len(text) - BEFORE.match(back, len(text) - start, len(text) - hi).end()
            if zone and left > hi:
                yield _layer(layer, lo, hi, zone)
                zone = []
            if not zone:
                lo = left
        zone.append(region)
        hi = AFTER.match(text, max(end, hi)).end()
    if zone:
        yield _layer(layer, lo, hi, zone)


def settled(layer: Layer) -> Layer | None:
    """The layer with all percent, byte and Unicode escapes undone until none is left, in one pass over a stack; bytes that are not ASCII become one replacement character each."""
    chars: list[str] = []
    lo: list[int] = []
    hi: list[int] = []
    for i, c in enumerate(layer.text):
        chars.append(c)
        lo.append(i)
        hi.append(i + 1)
        while True:
            for width, sign in ((3, "%"), (4, "\\x"), (6, "\\u")):
                tail = "".join(chars[-width:])
                if len(tail) == width and tail.startswith(sign) and re.fullmatch("[0-9A-Fa-f]+", tail[len(sign) :]):
                    code = int(tail[len(sign) :], 16)
                    break
            else:
                break
            first = lo[-width]
            del chars[-width:], lo[-width:], hi[-width:]
            chars.append(chr(code) if code < 0x80 or sign == "\\u" and not 0xD800 <= code < 0xE000 else "\ufffd")
            lo.append(first)
            hi.append(i + 1)
    if len(chars) == len(layer.text):
        return None
    return Layer("".join(chars), layer, [(0, len(chars), 0, len(layer.text), lambda i, j: (lo[i], hi[j - 1]))])


class Budget:
    """Bytes left for payloads of one text that grow much, what each payload was allowed, and ranges of the text not read to their end."""

    __slots__ = ("room", "allowed", "unopened")

    def __init__(self):
        self.room, self.allowed, self.unopened = MAX_DECODED, {}, set()


def children(layer: Layer, budget: Budget):
    """Layers one decoding step below."""

    def opened(raw: bytes, start: int, end: int):
        """(the payload, whether it was cut short); a payload that several layers hold is charged once."""
        if not MAGIC.match(raw):
            return raw, False
        mark, free = hashlib.blake2b(raw, digest_size=16).digest(), EXPANSION * len(raw)
        fresh = mark not in budget.allowed
        room = budget.allowed.setdefault(mark, max(free, budget.room))
        out, cut_short = inflate(raw, room)
        if fresh and len(out) > free:
            budget.room -= len(out)
        if cut_short:
            budget.unopened.add(layer.origin(start, end))
        return out, cut_short

    def of_bytes(unit: re.Pattern, m: re.Match):
        """Bytes that were written as units, one after another."""
        units = list(unit.finditer(layer.text, *m.span()))
        raw = bytes.fromhex("".join(u[1] for u in units))
        out, cut_short = opened(raw, *m.span())
        if out is not raw:
            text = readable(out, cut_short)
            return [] if text is None else [(*m.span(), text, 0)]
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return [(*m.span(), raw.decode("utf-8", "replace"), 0)]
        at, starts = byte_places(text), [*(u.start() for u in units), m.end()]
        return [(*m.span(), text, lambda i, j: (starts[at(i)], starts[at(j)]))]

    def percent(m):
        return of_bytes(PERCENT_UNIT, m)

    def byte_escape(m):
        return of_bytes(BYTE_UNIT, m)

    def unicode_escape(m):
        units = list(UNICODE_UNIT.finditer(layer.text, *m.span()))
        text = bytes.fromhex("".join(u[1] for u in units)).decode("utf-16-be", "replace")
        # A lone surrogate becomes one character, as a unit does.
        at, starts = unit_places(text), [*(u.start() for u in units), m.end()]
        return [(*m.span(), text, (lambda i, j: (starts[at(i)], starts[at(j)])) if at(len(text)) == len(units) else 0)]

    def joined(tokens):
        """The characters of tokens without padding, one after another, and the place of each in the layer."""
        body = "".join(t[0] for t in tokens).rstrip("=").replace("-", "+").replace("_", "/")
        starts = [0]
        for t in tokens:
            starts.append(starts[-1] + len(t[0]))

        def place(i):
            k = min(bisect_right(starts, i), len(tokens)) - 1
            return tokens[k].start() + i - starts[k]

        return body, place

    def of_text(text, first, body, place, shift=0):
        """Characters of `text`, which begins at byte `first` of what the body holds from `shift` on, to the characters that hold their bits."""
        at = byte_places(text)
        return lambda i, j: (place(shift + (first + at(i)) * 4 // 3), place(min(shift + -(-(first + at(j)) * 4 // 3), len(body)) - 1) + 1)

    def base64_whole(tokens):
        """The tokens, one after another, as one payload."""
        body, place = joined(tokens)
        if len(body) % 4 == 1:
            return []
        start, end = tokens[0].start(), tokens[-1].end()
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        out, cut_short = opened(raw, start, end)
        text = readable(out, cut_short)
        return [] if text is None else [(start, end, text, of_text(text, 0, body, place) if out is raw else 0)]

    def base64_within(tokens):
        """Texts and compressed payloads within the tokens, as words and paths glued to base64 shift its start."""
        body, place = joined(tokens)
        found = []
        for shift in range(4):
            part = body[shift:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            texts = [(m.start(), m.end(), m[0].decode("utf-8", "ignore"), m[0]) for m in RUN.finditer(raw)]
            spans = [(s, e, text, of_text(text, s, body, place, shift) if text.encode() == whole else 0) for s, e, text, whole in texts]
            for m in MAGIC.finditer(raw):
                # The first bytes tell most of what only looks like a deflated payload.
                head = raw[m.start() : m.start() + 1024]
                if head[:1] in b"\x1f\x78" and inflate(head, 64)[0] is head:
                    continue
                text = readable(*opened(raw[m.start() :], place(shift + m.start() * 4 // 3), tokens[-1].end()))
                if text is not None:
                    spans.append((m.start(), len(raw), text, 0))
                    break
            found += [(place(shift + s * 4 // 3), place(min(shift + -(-e * 4 // 3), len(body)) - 1) + 1, text, how) for s, e, text, how in spans]
        chosen: list[tuple] = []
        for f in sorted(found, key=lambda f: (f[0], -f[1])):
            if chosen and f[0] < chosen[-1][1]:
                if len(f[2]) > len(chosen[-1][2]):
                    chosen[-1] = f
            else:
                chosen.append(f)
        return chosen

    def base64_tokens(m):
        tokens = list(TOKEN.finditer(layer.text, *m.span()))
        if len(tokens) > 1 and len({len(t[0]) for t in tokens[:-1]}) == 1 and len(tokens[-1][0]) <= len(tokens[0][0]):
            if whole := base64_whole(tokens) or len(tokens) > 2 and base64_whole(tokens[:-1]):
                return whole
        out = []
        for t in tokens:
            if len(t[0].rstrip("=")) >= TOKEN_MIN:
                out += base64_whole([t]) or base64_within([t])
        return out or (base64_within(tokens) if len(tokens) > 1 else [])

    escapes = (("%", PERCENT, percent), ("\\u", UNICODE, unicode_escape), ("\\x", BYTE_ESCAPE, byte_escape))
    if layer.depth >= DEEP:
        if (whole := settled(layer)) is not None:
            yield whole
        escapes = ()
    for sign, pattern, decode in (*escapes, ("", BASE64, base64_tokens)):
        if sign in layer.text:
            yield from _zones(layer, pattern, decode)


def scan(text: str | None) -> dict:
    """Base findings and all findings of one text (null: empty), with the number of decoded layers and the ranges not read to their end.

    Every layer is opened, whatever the text's length: each step but
    decompression makes a text shorter, so the worklist ends.
    """
    text = text or ""
    base = matches(text)
    every, work, layers, budget, seen = set(base), [Layer(text)], 0, Budget(), set()
    while work:
        for child in children(work.pop(), budget):
            if not child.text:
                continue
            mark = (hashlib.blake2b(child.text.encode("utf-8", "replace"), digest_size=16).digest(), child.origin(0, len(child.text)))
            if mark in seen:
                continue
            seen.add(mark)
            layers += child.steps
            # What this layer has not decoded was told by the one before, where it is as long or longer.
            every.update((kind, *child.origin(s, e)) for kind, s, e in matches(child.text) if child.decoded(s, e))
            work.append(child)
    order = lambda f: (f[1], KINDS.index(f[0]), f[2])
    return {"base": sorted(base, key=order), "all": sorted(every, key=order), "layers": layers, "truncated": bool(budget.unopened), "unopened": sorted(budget.unopened)}


def told(findings) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in findings)


def redact(text: str | None, findings) -> str | None:
    """The text with every found range (by start), overlapping ones as one, replaced by a placeholder."""
    if not text or not findings:
        return text
    parts, at = [], 0
    for _, s, e in findings:
        if e <= at:
            continue
        if s >= at:
            parts += [text[at:s], PLACEHOLDER]
        at = e
    return "".join(parts) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, truncated boolean"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: counts and hash of the base findings, all findings, decoded layers.

    A null or empty text has no findings; a null id stays null; repeated rows
    are repeated; other columns are not read, so their names cannot clash.
    Empty table: empty result. No shuffle: one pass over the text in Arrow batches.
    """

    def run(batches):
        for b in batches:
            found = [scan(t) for t in b.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(f[0] == kind for f in x["base"]) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    *(count(k) for k in KINDS),
                    pa.array([hashlib.sha256(told(x["base"]).encode()).hexdigest() for x in found], pa.string()),
                    pa.array([told(x["all"]) for x in found], pa.string()),
                    pa.array([x["layers"] for x in found], pa.int64()),
                    pa.array([x["truncated"] for x in found], pa.bool_()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "truncated"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every found secret in `text_col` replaced; rows and columns stay. `length_col` follows the new text if it is there.

    A secret within an encoded region goes with the characters that hold it,
    within a compressed one with the whole region. A payload that was not read
    to its end is replaced as a whole, as secrets may lie beyond. Null texts
    stay null, empty ones empty; repeated rows get equal texts; other columns
    are carried as they are, whatever their names. Empty table: empty result.
    """

    def hidden(text):
        found = scan(text)
        return sorted(found["all"] + [("unopened", s, e) for s, e in found["unopened"]], key=lambda f: f[1])

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(text_col)
            texts = b.column(i).to_pylist()
            new = [redact(t, hidden(t)) for t in texts]
            b = b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))
            j = b.schema.get_field_index(length_col) if length_col else -1
            if j >= 0:
                old = b.column(j).to_pylist()
                lengths = [len(n) if n != t else o for n, t, o in zip(new, texts, old, strict=True)]
                b = b.set_column(j, b.schema.field(j), pa.array(lengths, b.schema.field(j).type))
            yield b

    return docs.mapInArrow(lean(run), docs.schema)
