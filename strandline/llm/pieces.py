"""SentencePiece segmentations sampled without replacement, and decoding.

The lattice of a text has an edge for every vocabulary piece that fits at a
position, weighted by the piece's rank in the vocabulary; characters without a
piece are spelled in byte pieces. Backward log-sums turn the weights into a
distribution over whole segmentations. A* search over perturbed regions draws
the k segmentations of largest Gumbel value: a region is "the same up to here,
then another edge", its value is a truncated Gumbel of its log mass, and the
largest open region is the one that is expanded next. Random numbers come from
a counter keyed by the row, so results do not depend on batches or partitions.

No piece of such a vocabulary spans a space that follows another character, so
a text falls into units (a word with the spaces before it) whose lattices are
independent; so are the parts of a unit between positions that no piece spans,
as between most characters of scripts without spaces. A block of texts builds
each distinct unit's lattice once, all parts at the same time, and samples all
occurrences at the same time. A long part that pieces span throughout is
summed and walked along one character after another.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import lean

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Characters of the texts that are handled at once.
BLOCK = 1 << 19
#: Regions of a segmentation that are opened at first; the rest is one region until it wins.
OPEN = 48
#: Characters of a unit from which it is parted, and of a part from which it is summed by itself; walks that are so few are followed one by one.
PARTED, LONG, FEW = 32, 512, 4
SPACE, LITERAL = "▁", "\U0010ffff"
UNIT = re.compile("\n| *[^ \n]+| +")

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(key, counter: np.ndarray | np.uint64) -> np.ndarray:
    """In (0, 1), from mixed keys and counters."""
    with np.errstate(over="ignore"):
        return ((mix64(key + (np.uint64(1) + counter) * _STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces, weights and prefix tables of a model file. It is read on the driver and travels with the job."""

    def __init__(self, model_file: str = DEFAULT_MODEL, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
        normal = [i for i in range(n) if not self.special[i] and not sp.is_byte(i)]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", pieces[i]) for i in normal):
            raise ValueError("a piece of this vocabulary spans two units")
        if (self.byte_id < 0).any():
            raise ValueError("this vocabulary has no byte pieces")
        rank = np.array([-sp.get_score(i) for i in normal])
        weight = -alpha * np.log(np.maximum(rank, 0) + 10)
        self.byte_weight = float(weight.min())
        surface = [b"" if self.special[i] else bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.surface = np.array([*surface, None], object)[:-1]
        prefixes: dict[int, dict[int, tuple[int, float]]] = {}
        for i, w in zip(normal, weight, strict=True):
            h = 0
            for k, ch in enumerate(pieces[i]):
                h = self.step(h, ord(ch))
                prefixes.setdefault(k + 1, {}).setdefault(h, (-1, 0.0))
            prefixes[len(pieces[i])][h] = (i, w)
        #: By length: sorted prefix hashes, the piece that ends there or -1, its weight, and where hashes with given leading 16 bits begin.
        self.tables = []
        for k in range(1, max(prefixes) + 1):
            items = sorted(prefixes[k].items())
            hashes = np.array([h for h, _ in items] + [2**64 - 1], np.uint64)  # the last stands for none
            begin = np.searchsorted(hashes[:-1] >> np.uint64(48), np.arange(65537, dtype=np.uint64)).astype(np.int32)
            self.tables.append((hashes, np.array([v[0] for _, v in items] + [-1], np.int32), np.array([v[1] for _, v in items] + [0.0]), begin))

    @staticmethod
    def find(hashes: np.ndarray, begin: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place of each h in `hashes`, or -1."""
        lead = (h >> np.uint64(48)).astype(np.int32)
        out = begin[lead]
        miss = np.flatnonzero(hashes[out] != h)
        end = begin[1:][lead[miss]]
        while len(miss):
            out[miss] += 1
            more = out[miss] < end
            out[miss[~more]] = -1
            miss, end = miss[more], end[more]
            wrong = hashes[out[miss]] != h[miss]
            miss, end = miss[wrong], end[wrong]
        return out

    @staticmethod
    def step(h: int, code: int) -> int:
        x = ((h ^ code) * 0x9E3779B97F4A7C15) & (2**64 - 1)
        return x ^ (x >> 29)

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(self.surface[ids].tolist())

    def decode(self, ids) -> str:
        """The text of piece ids; the first space is the encoder's own."""
        raw = self.raw(np.asarray(ids, np.int32))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


class Lattice:
    """Edges of many units at once; node numbers are positions in the joined units."""

    def __init__(self, units: list[str], vocabulary: Vocabulary):
        # A separator after each unit: a node without edges, where the backward sum is 0.
        lengths = np.fromiter(map(len, units), np.int32, len(units))
        long_ = lengths >= PARTED
        #: Units from PARTED characters on come last: the place of each given unit.
        self.moved = np.arange(len(units))
        if long_.any():
            order = np.argsort(long_, kind="stable")
            self.moved[order] = np.arange(len(units))
            units, lengths = [units[i] for i in order.tolist()], lengths[order]
        joined = "\0".join([*units, ""]).replace(SPACE, LITERAL).replace(" ", SPACE)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(lengths + 1, dtype=np.int32) - 1
        self.first = (ends - lengths).astype(np.int64)
        n = len(code)
        left = np.repeat(ends, lengths + 1) - np.arange(n, dtype=np.int32)
        at = np.flatnonzero(left).astype(np.int32)
        alone = left > 0
        # Where the units begin that are looked at for parts.
        short = len(units) - int(long_.sum())
        parted = int(ends[short - 1]) + 1 if short else 0
        crossings = np.zeros(n - parted + 1, np.int64)
        h = np.zeros(len(at), np.uint64)
        starts, sizes, ids, weights = [], [], [], []
        with np.errstate(over="ignore"):
            for k, (hashes, piece, weight, begin) in enumerate(vocabulary.tables, 1):
                if k > 1:
                    inside = left[at] >= k
                    at, h = at[inside], h[inside]
                if not len(at):
                    break
                h = (h ^ code[at + (k - 1)]) * _STEP
                h ^= h >> np.uint64(29)
                i = vocabulary.find(hashes, begin, h)
                known = np.flatnonzero(i >= 0)
                at, h, i = at[known], h[known], i[known]
                here = piece[i]
                ends_here = np.flatnonzero(here >= 0)
                start = at[ends_here]
                if k == 1:
                    alone[start] = False
                elif parted < n:
                    wide = start[np.searchsorted(start, parted) :] - parted
                    crossings += np.bincount(wide + 1, minlength=len(crossings)) - np.bincount(wide + k, minlength=len(crossings))
                starts.append(start)
                sizes.append(np.full(len(start), k, np.int32))
                ids.append(here[ends_here])
                weights.append(weight[i[ends_here]])
        spelled = np.flatnonzero(alone).astype(np.int32)
        char = code[spelled].astype(np.int32)
        char[char == ord(LITERAL)] = ord(SPACE)
        starts.append(spelled)
        sizes.append(np.ones(len(spelled), np.int32))
        ids.append(-1 - char)
        weights.append(vocabulary.byte_weight * (1.0 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)))
        start, size, piece, weight = (np.concatenate(x) for x in (starts, sizes, ids, weights))
        # Positions that no piece spans part a long unit; `left` becomes the characters left in the part.
        #: First node of each part, and the range of each unit's parts.
        self.parts, self.part_lo, self.part_hi = self.first, np.arange(len(units)), np.arange(len(units)) + 1
        if short < len(units):
            spanned = np.cumsum(crossings)[:-1] > 0
            borders = np.where(spanned, np.int32(n), np.arange(parted, n, dtype=np.int32))
            following = np.minimum.accumulate(borders[::-1])[::-1]
            begins = parted + np.flatnonzero(~spanned & (left[parted:] > 0))
            left[parted:] = np.where(left[parted:] > 0, np.concatenate((following[1:], [n])) - np.arange(parted, n), 0)
            self.parts = np.concatenate((self.first[:short], begins))
            self.part_lo, self.part_hi = np.searchsorted(self.parts, self.first), np.searchsorted(self.parts, ends)
        # By characters left in the part, for the backward sums; in a node by falling length, since long pieces are the likely ones.
        by_left = np.argsort(np.minimum(left, 65535).astype(np.uint16) if n and left.max() < 65536 else left, kind="stable")
        place = np.empty(n, np.int32)
        place[by_left] = np.arange(n, dtype=np.int32)
        longest = len(vocabulary.tables) + 1
        rank = place[start].astype(np.int64) * longest + (longest - size)
        if n * longest < 2**31:
            # Sorted with their places, as numbers sort faster than places do.
            rank = rank << 32 | np.arange(len(start))
            rank.sort()
            order = rank & 0xFFFFFFFF
        else:
            order = np.argsort(rank)
        start, weight, self.piece, size = start[order], weight[order], piece[order], size[order]
        last = size == left[start]
        # Node n stands for the end of any part.
        after = np.where(last, n, start + size)
        beta = np.zeros(n + 1)
        head = np.flatnonzero(np.concatenate((np.ones(1, bool), start[1:] != start[:-1]))) if len(start) else np.empty(0, np.int64)
        node = start[head]
        tail = np.concatenate((head, [len(start)]))
        count = np.diff(tail)
        node_left = left[node]
        log_prob = np.empty(len(start))
        long_parts = self.parts[left[self.parts] >= LONG] if len(self.parts) else self.parts
        alone = np.zeros(n, bool)
        for p in long_parts.tolist():
            alone[p : p + int(left[p])] = True
        most = int(node_left[~alone[node]].max(initial=0)) if len(long_parts) else node_left[-1] if len(head) else 0
        cuts = np.searchsorted(node_left, np.arange(1, most + 2))
        for r in range(len(cuts) - 1):
            a, b = cuts[r], cuts[r + 1]
            if a == b:
                continue
            lo, hi = tail[a], tail[b]
            s = weight[lo:hi] + beta[after[lo:hi]]
            seg = head[a:b] - lo
            top = np.maximum.reduceat(s, seg)
            total = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, count[a:b])), seg))
            beta[node[a:b]] = total
            log_prob[lo:hi] = s - np.repeat(total, count[a:b])
        #: Edge range of each node, cumulative probabilities within it, and the node an edge leads to (-1: the part's end).
        self.lo, self.hi = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.lo[node], self.hi[node] = head, tail[1:]
        for p in long_parts.tolist():
            self._sum_along(p, p + int(left[p]), weight, size, log_prob, longest)
        self.log_prob = np.minimum(log_prob, 0.0, out=log_prob)
        cumulative = np.cumsum(np.exp(log_prob))
        if len(head):
            cumulative -= np.repeat(np.concatenate(([0.0], cumulative[tail[1:-1] - 1])), count)
            cumulative[tail[1:] - 1] = 2.0
        self.cumulative = cumulative
        self.next = np.where(last, -1, after).astype(np.int32)
        self.start = start

    def _sum_along(self, begin: int, end: int, weight: np.ndarray, size: np.ndarray, log_prob: np.ndarray, longest: int) -> None:
        """Backward sums of one long part, from its end: shares of each node's edges. Sums are kept within range, as only their ratios count."""
        step = 1 << 14
        after = [1.0] + [0.0] * (longest + 1)
        for top in range(end, begin, -step):
            bottom = max(begin, top - step)
            lo, hi = self.lo[bottom:top], self.hi[bottom:top]
            edges = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            shares, many = np.exp(weight[edges]).tolist(), (hi - lo).tolist()
            sizes, k = size[edges].tolist(), len(edges)
            for count in reversed(many):
                k -= count
                total = 0.0
                for e in range(k, k + count):
                    v = shares[e] * after[sizes[e] - 1]
                    shares[e] = v
                    total += v
                for e in range(k, k + count):
                    shares[e] /= total
                after.insert(0, total)
                after.pop()
                if total < 1e-200:
                    after = [x * 1e200 for x in after]
            with np.errstate(divide="ignore"):
                log_prob[edges] = np.log(shares)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node."""
        edge = self.lo[node]
        more = np.flatnonzero(u > self.cumulative[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] > self.cumulative[edge[more]]]
        return edge

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to its unit's end: (edges one walk after another, number of edges of each). Node -1: nothing."""
        count = np.zeros(len(node), np.int64)
        live = np.flatnonzero(node >= 0)
        at, k, steps, alone = node[live], key[live], [], []
        step = 0
        while len(live) > (FEW if step else 0):
            edge = self.draw(at, uniform(k, np.uint64(step)))
            steps.append((live, edge))
            count[live] += 1
            at = self.next[edge]
            more = at >= 0
            live, at, k = live[more], at[more], k[more]
            step += 1
        for lane, place, own in zip(live.tolist(), at.tolist(), k, strict=True):
            alone.append((lane, self._walk_on(place, own, step)))
            count[lane] += len(alone[-1][1])
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for s, (lanes, edge) in enumerate(steps):
            out[first[lanes] + s] = edge
        for lane, edges in alone:
            out[first[lane] + step : first[lane] + step + len(edges)] = edges
        return out, count

    def _walk_on(self, node: int, key: np.uint64, step: int) -> list[int]:
        """The rest of one walk, edge by edge."""
        lo, cumulative, following, out, drawn = self.lo, self.cumulative, self.next, [], 32
        while node >= 0:
            for u in uniform(key, np.arange(step, step + drawn, dtype=np.uint64)).tolist():
                edge = int(lo[node])
                while u > cumulative[edge]:
                    edge += 1
                out.append(edge)
                node = int(following[edge])
                if node < 0:
                    break
            step += drawn
            drawn = min(2 * drawn, 1 << 14)
        return out


class Search:
    """Perturbed A* over one text's segmentations; `lattice` is shared by the texts of a block."""

    def __init__(self, lattice: Lattice, key: np.uint64):
        self.lattice, self.key, self.heap, self.pushed, self.pushes, self.drawn = lattice, key, [], 0, 0, ()
        self.best = float(-np.log(-np.log(self._uniform(1)[0])))
        self.samples: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.gumbels: list[float] = []

    def _uniform(self, n):
        if self.pushed + n > len(self.drawn):
            self.drawn = uniform(self.key ^ np.uint64(0xA5A5A5A5), np.arange(2 * (self.pushed + n) + 2 * OPEN + 8, dtype=np.uint64))
        self.pushed += n
        return self.drawn[self.pushed - n : self.pushed]

    def emit(self, edges: np.ndarray, from_: int, excluded: tuple) -> None:
        """Take a segmentation that was drawn in the region (same up to `from_`, no edge of `excluded` there) and split what is left of it."""
        self.samples.append(edges)
        self.before.append(np.concatenate(([0.0], np.cumsum(self.lattice.log_prob[edges]))))
        self.gumbels.append(self.best)
        self._open(len(self.samples) - 1, from_, excluded, self.best, OPEN)

    def _open(self, sample: int, from_: int, excluded: tuple, bound: float, room: int, value: float | None = None) -> None:
        """Push the regions along `sample` from token `from_` on: one for each of `room` tokens, and one for all the others.

        Their values are Gumbels truncated at `bound`; with `value` they are drawn freely and then lowered together so that the largest is that.
        """
        edges, lattice = self.samples[sample], self.lattice
        to = min(len(edges), from_ + room)
        if from_ >= to:
            return
        before, here = self.before[sample], edges[from_:to]
        start = lattice.start[here]
        width = lattice.hi[start] - lattice.lo[start]
        width[0] -= len(excluded)
        used = np.exp(lattice.log_prob[here])
        if excluded:
            used[0] += float(np.exp(lattice.log_prob[list(excluded)]).sum())
        mass = np.full(to - from_ + 1, -np.inf)
        with np.errstate(divide="ignore"):
            mass[:-1] = before[from_:to] + np.log(np.where(width > 1, np.maximum(1.0 - used, 1e-300), 0.0))
            if to < len(edges):
                mass[-1] = before[to] + np.log(-np.expm1(before[-1] - before[to]))
        g = -np.log(-np.log(self._uniform(len(mass))))
        with np.errstate(invalid="ignore", over="ignore"):
            if value is None:
                values = mass - np.log(np.exp(-g) + np.exp(mass - bound))
            else:
                z = mass + g
                values = value - np.log1p(np.maximum(np.exp(value - z) - np.exp(value - z.max()), 0.0))
        values[~np.isfinite(mass)] = -np.inf
        self._put(values, (sample, from_, to, excluded, 4 * room))

    def _put(self, values: np.ndarray, regions: tuple) -> None:
        i = int(values.argmax())
        if values[i] > -np.inf:
            self.pushes += 1
            heapq.heappush(self.heap, (-float(values[i]), self.pushes, i, values, regions))

    def next_region(self):
        """The region of the next segmentation, (sample, at, excluded edges), or None."""
        while self.heap:
            value, _, i, values, regions = heapq.heappop(self.heap)
            values[i] = -np.inf
            self._put(values, regions)
            sample, from_, to, excluded, room = regions
            if from_ + i < to:
                self.best = -value
                return sample, from_ + i, (*(excluded if i == 0 else ()), int(self.samples[sample][from_ + i]))
            self._open(sample, to, (), np.inf, room, -value)
        return None

    def threshold(self) -> float:
        return -self.heap[0][0] if self.heap else -np.inf


def _blocks(texts):
    block, load = [], 0
    for i, t in enumerate(texts):
        block.append((i, t))
        load += len(t or "")
        if load >= BLOCK:
            yield block
            block, load = [], 0
    if block:
        yield block


def segment_block(keys: list[int], texts: list[str | None], vocabulary: Vocabulary, samples: int):
    """For each text the list of its samples: (edges' pieces with byte codes, log probability, Gumbel value, log inclusion)."""
    numbers: dict[str, int] = defaultdict(count().__next__)
    occurrences, per_text = [], []
    for t in texts:
        units = UNIT.findall(" " + t) if t else []
        occurrences.extend(map(numbers.__getitem__, units))
        per_text.append(len(units))
    lattice = Lattice(list(numbers), vocabulary)
    # From here on a unit is a part.
    seen = lattice.moved[np.array(occurrences, np.int64)]
    parts = lattice.part_hi[seen] - lattice.part_lo[seen]
    upto = np.concatenate(([0], np.cumsum(parts)))
    node = lattice.parts[np.repeat(lattice.part_lo[seen] - upto[:-1], parts) + np.arange(upto[-1])]
    first_unit = upto[np.concatenate(([0], np.cumsum(per_text)))]
    per_text = np.diff(first_unit)
    text_key = np.array(keys, np.uint64)
    which = np.repeat(np.arange(len(texts)), per_text)
    within = np.arange(len(node)) - first_unit[which]

    def walked(start, sample):
        with np.errstate(over="ignore"):
            key = mix64(text_key[which] + np.uint64(sample) * _M1) + within.astype(np.uint64) * _M2
        return lattice.walk(start, key)

    searches = [Search(lattice, np.uint64(k)) for k in keys]
    regions: list = [(None, 0, ())] * len(texts)
    starts, unit_of = node, []
    for sample in range(samples):
        edges, steps = walked(starts, sample)
        bounds = np.concatenate(([0], np.cumsum(steps)))[first_unit]
        every_unit = np.repeat(np.arange(len(node), dtype=np.int32), steps)
        for d, s in enumerate(searches):
            if regions[d] is None:
                continue
            fresh, units = edges[bounds[d] : bounds[d + 1]], every_unit[bounds[d] : bounds[d + 1]]
            old, at, excluded = regions[d]
            if old is None:
                s.emit(fresh, 0, ())
                unit_of.append([units])
            else:
                head, edge = s.samples[old][:at], regions_edge[d]
                s.emit(np.concatenate((head, [edge], fresh)), at, excluded)
                unit_of[d].append(np.concatenate((unit_of[d][old][: at + 1], units)))
        if sample + 1 == samples:
            break
        starts = np.full(len(node), -1, np.int64)
        regions_edge: list = [None] * len(texts)
        for d, s in enumerate(searches):
            regions[d] = s.next_region() if regions[d] is not None else None
            if regions[d] is None:
                continue
            old, at, excluded = regions[d]
            n = lattice.start[s.samples[old][at]]
            options = np.array([e for e in range(lattice.lo[n], lattice.hi[n]) if e not in excluded])
            p = np.cumsum(np.exp(lattice.log_prob[options] - lattice.log_prob[options].max()))
            edge = int(options[min(np.searchsorted(p, s._uniform(1)[0] * p[-1], side="right"), len(options) - 1)])
            regions_edge[d] = edge
            unit = unit_of[d][old][at]
            starts[unit] = lattice.next[edge]
            starts[unit + 1 : first_unit[d + 1]] = node[unit + 1 : first_unit[d + 1]]
    out = []
    for s in searches:
        kappa, got = s.threshold(), []
        for edges, before, g in zip(s.samples, s.before, s.gumbels, strict=True):
            lp = float(before[-1])
            gap = lp - kappa
            got.append((lattice.piece[edges], lp, g, 0.0 if kappa == -np.inf else float(gap if gap < -30 else np.log(-np.expm1(-np.exp(min(gap, 700)))))))
        out.append(got)
    return out


def spelled(pieces: np.ndarray, byte_id: np.ndarray) -> np.ndarray:
    """Piece ids, with characters that have no piece written in byte pieces."""
    low = np.flatnonzero((pieces < 0) & (pieces >= -0x80))
    if len(low):
        pieces = pieces.copy()
        pieces[low] = byte_id[-1 - pieces[low]]
    odd = np.flatnonzero(pieces < 0)
    if not len(odd):
        return pieces.astype(np.int32, copy=False)
    parts, at = [], 0
    for i in odd:
        parts += [pieces[at:i], byte_id[list(chr(-1 - pieces[i]).encode("utf-8", "surrogatepass"))]]
        at = i + 1
    return np.concatenate([*parts, pieces[at:]]).astype(np.int32)


def row_key(x) -> int:
    return xxhash.xxh3_64_intdigest(str(x))


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, model_file: str = DEFAULT_MODEL, alpha: float = 1.0) -> DataFrame:
    """(doc_id, sample, n_pieces, log_prob, gumbel, log_inclusion, round_trip, pieces): up to `samples` rows for each row of `docs`.

    Samples are distinct and come by falling Gumbel value. log_inclusion is
    the log of the chance that this segmentation is among those drawn, given
    the next value below. round_trip: decoding gives the text back. A null or
    empty text has one segmentation without pieces; a text with fewer
    segmentations than asked for has them all. Repeated rows get equal
    samples; other columns are not read. Equal Gumbel values fall to the region
    that was opened first. Empty table: empty result. No shuffle.
    """
    vocabulary = Vocabulary(model_file, alpha)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for block in _blocks(x.as_py() for x in b.column(1)):
                at = [i for i, _ in block]
                texts = [t for _, t in block]
                found = segment_block([row_key(ids[i]) for i in at], texts, vocabulary, samples)
                raws = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
                rows = [(ids[i], n + 1, spelled(pieces, vocabulary.byte_id), lp, g, q, raw) for i, raw, got in zip(at, raws, found, strict=True) for n, (pieces, lp, g, q) in enumerate(got)]
                sizes = [len(r[2]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array(sizes, pa.int32()),
                        *(pa.array([r[k] for r in rows], pa.float64()) for k in (3, 4, 5)),
                        pa.array([vocabulary.raw(r[2]) == r[6] for r in rows], pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate([r[2] for r in rows]) if rows else [], pa.int32())),
                    ],
                    names=["doc_id", "sample", "n_pieces", "log_prob", "gumbel", "log_inclusion", "round_trip", "pieces"],
                )

    schema = "doc_id long, sample int, n_pieces int, log_prob double, gumbel double, log_inclusion double, round_trip boolean, pieces array<int>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), schema)


def decode_pieces(df: DataFrame, pieces_col: str = "pieces", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """`df` with the decoded `text` of an array of piece ids in place of `pieces_col`.

    A null array stays null, an empty one is an empty text. Bytes that are no
    UTF-8 (a part of a segmentation) are read with replacement characters. A
    column named text is replaced; others are carried as they are. Repeated
    rows are repeated. Empty table: empty result. No shuffle.
    """
    vocabulary = Vocabulary(model_file)
    rest = [c for c in df.columns if c not in (pieces_col, "text")]

    def run(batches):
        for b in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, "text"])

    shaped = df.select(*rest, pieces_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shaped.schema.fields[: len(rest)]), "text string"])
    return shaped.mapInArrow(lean(run), schema)
