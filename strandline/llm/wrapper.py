"""Main text of pages by wrapper induction over the pages of a host.

Each page is parsed into a tree of block elements. Siblings that are alike are
one node: the paragraphs or rows of a parent, and neighbours of one label with
children of the same labels. Pages of one host that have the same tree add up
place by place; the different trees of a host are then aligned by simple tree
matching and merged into the host's template. What the template knows of a
slot decides: a slot that several different pages hold unchanged is template,
one made of links is navigation, one that varies is content. The article is
the deepest part of the page that still holds nearly all of the varying text
that is not links: going down from the root, the part with the most text is
entered as long as what stands beside it is thin and no heading. The names of
elements and classes only break ties: they say how much beside the article may
be left out, and what within it is small and not the article's.

All pages and all their different trees count, whatever their number. Adding up
trees and their numbers does not depend on order, and trees are merged two and
two along the bits of a hash of their form, so a part of them merged in a task
of its own gives the same template as all of them in one. Words of classes, ids
and roles tell siblings apart if EVIDENCE different pages of the host, or half
of its pages, hold them; those of single pages would part what is alike.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import cut, lean

#: A slot counts as constant, and numbers as telling, when this many different pages, at least, hold it.
EVIDENCE = 8
#: Different trees of a host that a task merges, about; nodes that a task adds up before it hands them on.
MAX_FORMS, OPEN_NODES = 2048, 1 << 16
#: Elements nested deeper than this belong to the slot they are in; their text stays. Siblings of one label, or labels, beyond which siblings are one node.
MAX_DEPTH, MANY = 64, 32
#: Whether classes, ids and roles tell siblings apart; a host without words that do is read without them.
GRAINS = (True, False)
#: Bits of a form's hash by which partial templates are merged at once.
BITS = 8
SALTS = 16
#: Share of links that makes a slot navigation; share of a host's varying text that outweighs hints.
LINKS, BULK = 0.5, 0.8
#: What stands beside the article has at most this share of its text; where names say so, as much as the article.
THIN = 1 / 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Templates up to this size in all are broadcast, those of the largest hosts first; the others are joined by host.
BROADCAST_BYTES, BROADCAST_HOSTS = 16 << 20, 20_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": (), "body": ("head",)}
SCOPES = frozenset("ul ol dl table article section body html".split())
#: Elements whose siblings are records of one slot.
RECORDS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre figcaption caption legend summary address".split())
#: Hints at what is not the article: elements, and words of classes, ids and roles. A name is a hint if all its words are marks or fillers.
ASIDE_TAGS = frozenset("head nav footer aside form button select dialog menu template svg object fieldset datalist".split())
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe signup login ad ads advert adverts advertisement sponsor sponsored promo promotion share sharing social related recommended comment comments respond replies reply disqus search widget toolbar skip pagination pager complementary contentinfo".split()
)
FILLERS = frozenset("area bar block box button buttons container form group icons inner items js left links list main outer page panel post posts right section site slot top bottom unit wrap wrapper".split())
WORD = re.compile(r"[a-z]+")


class Element:
    """A block element; mark: 0 none, 1 a hint that it is not the article, 2 hidden from readers; shade: the same, or that of an element around it."""

    __slots__ = ("tag", "names", "mark", "shade", "kids", "blocks", "depth", "within")

    def __init__(self, tag, names="", mark=0, shade=0, depth=0, within=False):
        self.tag, self.names, self.mark, self.shade, self.depth, self.within = tag, names, mark, shade, depth, within
        self.kids: list[Element] = []
        self.blocks: list[int] = []


def hinted(names: list[str]) -> bool:
    """Whether one of these names says that its element is not the article."""
    for name in names:
        words = WORD.findall(name)
        if words and any(w in MARKS for w in words) and all(w in MARKS or w in FILLERS for w in words):
            return True
    return False


def element(tag: str, attributes: str, above: Element) -> Element:
    names, mark = [], 0
    for name, value in ATTRIBUTE.findall(attributes) if attributes and attributes != "/" else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            mark = 2
        elif name in ("class", "id", "role"):
            names += re.sub(r"[0-9]+", "", value).split()
    article = tag in ("article", "main") or "main" in names
    # The header of an article is its title; names speak of sections, not of single paragraphs and headings.
    if not mark and (tag in ASIDE_TAGS or tag == "header" and not above.within or tag not in RECORDS and not article and hinted(names)):
        mark = 1
    return Element(tag, " ".join(names), mark, max(mark, above.shade), above.depth + 1, above.within or article)


def parse(page: str | None) -> tuple[Element, list[tuple[Element, str, int]]]:
    """The root, and (element, text, characters in links) of each block in page order."""
    root = Element("")
    out: list[tuple[Element, str, int]] = []
    stack: list[tuple[str, Element]] = [("", root)]
    text: list[str] = []
    linked: list[str] = []
    in_link = False
    page = page or ""

    def clean(parts):
        return " ".join(entities.unescape("".join(parts)).split())

    def flush():
        if text:
            whole = clean(text)
            if whole:
                own = stack[-1][1]
                own.blocks.append(len(out))
                out.append((own, whole, len(clean(linked)) if linked else 0))
            text.clear()
            linked.clear()

    def close(names, scope=True):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return
            if scope and stack[i][0] in SCOPES:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
                if in_link:
                    linked.append(m[0])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "a":
                in_link = False
            elif tag == "br":
                text.append(" ")
            elif tag not in INLINE and tag not in VOID:
                close((tag,), tag not in SCOPES)
            continue
        if tag in INLINE:
            in_link = in_link or tag == "a"
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        flush()
        close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag])
        above = stack[-1][1]
        own = above
        if above.depth < MAX_DEPTH:
            own = element(tag, m[3] or m[6] or "", above)
            above.kids.append(own)
        stack.append((tag, own))
    flush()
    return root, out


def filled(e: Element) -> bool:
    """Drop elements without text."""
    e.kids = [k for k in e.kids if filled(k)]
    return bool(e.kids or e.blocks)


def label(e: Element, names: bool) -> str:
    """What tells siblings apart; a mark is part of it at any coarseness."""
    sign = "!" * e.mark
    return f"{e.tag}{sign} {e.names}".rstrip() if names else e.tag + sign


def siblings(kids: list[Element], names: bool, together: bool) -> list[list[Element]]:
    """Groups of children that are one node each, in order."""
    labels = [label(k, names) for k in kids]
    often = Counter(labels)
    out: list[list[Element]] = []
    by_label: dict[str, list[Element]] = {}
    last = None
    for k, name in zip(kids, labels, strict=True):
        if together or k.tag in RECORDS or often[name] > MANY:
            if name in by_label:
                by_label[name].append(k)
            else:
                out.append([k])
                by_label[name] = out[-1]
            last = None
            continue
        alike = (name, {label(c, names) for c in k.kids})
        if alike == last:
            out[-1].append(k)
        else:
            out.append([k])
            last = alike
    # Too many nodes: first what has one label is one, then what has one element.
    if len(out) > MANY and (names or not together):
        return siblings(kids, names and not together, True)
    return out


def words_of(e: Element) -> set[str]:
    """All words of classes, ids and roles in a tree."""
    return set(e.names.split()).union(*map(words_of, e.kids))


def tell(e: Element, words) -> None:
    """Leave only these words in a tree."""
    e.names = " ".join(w for w in e.names.split() if w in words)
    for k in e.kids:
        tell(k, words)


def slots(root: Element, grain: int) -> tuple[list, list[list[int]]]:
    """The page's form ([label, children]) at one coarseness, and the blocks of each node, both in preorder."""
    names = GRAINS[grain]
    places: list[list[int]] = []

    def node(group: list[Element]) -> list:
        places.append([b for e in group for b in e.blocks])
        kids = [k for e in group for k in e.kids]
        told = names and len({e.names for e in group}) == 1
        return [label(group[0], told), [node(g) for g in siblings(kids, names, len(group) > 1)] if kids else []]

    return node([root]), places


def fingerprint(texts) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(texts)) >> 1


# The numbers of a slot: [pages, hash of its text (-1: differing), hashes of up to EVIDENCE different pages, characters, characters in links].
# Hashes of pages are the smallest ones, so that adding does not depend on order; they are kept only as long as the text is the same.
def add(a: list, b: list) -> None:
    if not b[0]:
        return
    if not a[0]:
        a[:] = [b[0], b[1], list(b[2]), b[3], b[4]]
        return
    a[0], a[3], a[4] = a[0] + b[0], a[3] + b[3], a[4] + b[4]
    if a[1] != b[1]:
        a[1] = -1
    a[2] = [] if a[1] == -1 else sorted({*a[2], *b[2]})[:EVIDENCE]


def numbers(places, found, mark: int) -> list[list]:
    out = []
    for blocks in places:
        if not blocks:
            out.append([0, 0, [], 0, 0])
            continue
        out.append([1, fingerprint([found[i][1] for i in blocks]), [mark], sum(len(found[i][1]) for i in blocks), sum(found[i][2] for i in blocks)])
    return out


def page_mark(found) -> int:
    """Pages that differ only in what is marked as not the article are copies, unless that is most of their text."""
    own = [text for e, text, _ in found if not e.shade]
    if 2 * sum(map(len, own)) < sum(len(text) for _, text, _ in found):
        own = [text for e, text, _ in found if e.shade < 2]
    return fingerprint(own)


def match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the size of the largest top-down matching that keeps order; memo keeps it for `pairs`. Nodes are [label, children, ...]."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        # Children whose label the other side lacks match nothing: they repeat the row or column before them.
        some = {x[0] for x in a[1]} & {y[0] for y in b[1]}
        ys = [y for y in b[1] if y[0] in some]
        m = [[0] * (len(ys) + 1)]
        for x in a[1]:
            if x[0] not in some:
                continue
            row = [0]
            for j, y in enumerate(ys):
                row.append(max(row[j], m[-1][j + 1], m[-1][j] + match(x, y, memo)))
            m.append(row)
        memo[key] = (m[-1][-1] + 1, m, some)
    return memo[key][0]


def pairs(a: list, b: list, memo: dict):
    """(child of a or None, child of b or None) in an order that keeps both orders."""
    match(a, b, memo)
    (_, m, some), i, j, out = memo[(id(a), id(b))], len(a[1]), len(b[1]), []
    r, c = len(m) - 1, len(m[0]) - 1
    while i or j:
        known_x, known_y = i and a[1][i - 1][0] in some, j and b[1][j - 1][0] in some
        if known_x and known_y and m[r][c] > max(m[r - 1][c], m[r][c - 1]):
            i, j, r, c = i - 1, j - 1, r - 1, c - 1
            out.append((a[1][i], b[1][j]))
        elif i and (not known_x or m[r][c] == m[r - 1][c]):
            i, r = i - 1, r - bool(known_x)
            out.append((a[1][i], None))
        else:
            j, c = j - 1, c - bool(known_y)
            out.append((None, b[1][j]))
    return out[::-1]


def grown(form: list, given: list[list]) -> list:
    """A form as template nodes [label, children, numbers]; given: the numbers in preorder."""
    rest = iter(given)

    def one(n):
        own = [n[0], [], list(next(rest))]
        own[1] = [one(c) for c in n[1]]
        return own

    return one(form)


def merge(template: list, other: list, memo: dict | None = None) -> None:
    """Fold another tree with numbers into `template`."""
    memo = {} if memo is None else memo
    add(template[2], other[2])
    if other[1]:
        children = []
        for x, y in pairs(template, other, memo):
            if x is None:
                x = y
            elif y is not None:
                merge(x, y, memo)
            children.append(x)
        template[1] = children


def preorder(n: list, out: list | None = None) -> list:
    out = [] if out is None else out
    out.append(n)
    for c in n[1]:
        preorder(c, out)
    return out


def hash_of(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form)


def fold(forms, hashes=None) -> list:
    """The template of (pages, form as JSON, numbers) of one host: those whose hashes share more leading bits are merged first.

    hashes: of the forms. A form may be the template of all whose hash begins
    so, with the rest of its bits 0; it is what merging them here would give.
    """
    parts = sorted((hash_of(form) if hashes is None else hashes[i], form, given) for i, (_, form, given) in enumerate(forms))

    def one(lo: int, hi: int) -> list:
        if hi - lo == 1:
            return grown(json.loads(parts[lo][1]), parts[lo][2])
        apart, mid = parts[lo][0] ^ parts[hi - 1][0], lo + 1
        if apart:
            bit = 1 << apart.bit_length() - 1
            mid = next(i for i in range(lo, hi) if parts[i][0] & bit)
        out = one(lo, mid)
        merge(out, one(mid, hi))
        return out

    return one(0, len(parts)) if parts else ["", [], [0, 0, [], 0, 0]]


def bare(n: list) -> list:
    """The form of a template."""
    return [n[0], [bare(c) for c in n[1]]]


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


class Wrapper:
    """A host's template, and what it says of each form of page; words: those of classes, ids and roles that tell (None: all)."""

    def __init__(self, template: list, grain: int, words=None):
        self.template, self.grain, self.known = template, grain, {}
        self.words = words if words is None else frozenset(words)

    def chosen(self, form: list) -> list[bool]:
        """Whether each node of a page's form is the article's."""
        key = json.dumps(form)
        if key not in self.known:
            if len(self.known) >= MAX_FORMS:
                self.known.clear()
            self.known[key] = self._judge(form)
        return self.known[key]

    def _judge(self, form: list) -> list[bool]:
        nodes = preorder(form)
        slot: dict[int, list] = {}
        memo: dict = {}

        def align(t, p):
            slot[id(p)] = t[2]
            if p[1]:
                for x, y in pairs(t, p, memo):
                    if x is not None and y is not None:
                        align(x, y)

        align(self.template, form)
        none = [0, 0, [], 0, 0]
        of = [slot.get(id(n), none) for n in nodes]
        number = {id(n): k for k, n in enumerate(nodes)}
        held = [t[0] > 0 or id(n) not in slot for n, t in zip(nodes, of, strict=True)]
        constant = [t[0] > 0 and t[1] != -1 and len(t[2]) >= EVIDENCE and not n[0].startswith("h1") for n, t in zip(nodes, of, strict=True)]
        links = [t[3] > 0 and t[4] > LINKS * t[3] for t in of]
        own = [n[0].split(" ")[0].count("!") for n in nodes]
        tags = [n[0].split(" ")[0].rstrip("!") for n in nodes]
        # Roles tell at the finest grain only; elements always.
        article = [t in ("article", "main") or " main" in n[0] for n, t in zip(nodes, tags, strict=True)]
        marks = self._above(form, number, own)
        telling = max((t[0] for t in of), default=0) >= EVIDENCE
        # Where nothing varies all pages are copies of one, and nothing tells template from content.
        if not any(t[1] == -1 and not m for t, m in zip(of, marks, strict=True)):
            constant = [False] * len(nodes)
        # Text that varies and is not links, of a slot and of all below it; what is hidden has none.
        mass = [0 if c or x or m == 2 else t[3] for t, c, x, m in zip(of, constant, links, marks, strict=True)]
        below, holds = list(mass), list(article)
        for k in range(len(nodes) - 1, -1, -1):
            for c in nodes[k][1]:
                below[k] += below[number[id(c)]]
                holds[k] = holds[k] or holds[number[id(c)]]
        root = self._root(nodes, number, tags, own, mass, below, holds, article, telling)
        inside = set()

        def enter(n, marked):
            k = number[id(n)]
            # Within the article a name speaks for parts that are not its bulk.
            marked = max(marked, own[k] if k != root and (own[k] == 2 or below[k] <= BULK * below[root]) else 0)
            if not marked:
                inside.add(k)
            for c in n[1]:
                enter(c, marked)

        enter(nodes[root], 2 if own[root] == 2 else 0)
        text = sum(mass[k] for k in inside)
        return [k in inside and held[k] and not constant[k] and not (links[k] and text and not any(article)) for k in range(len(nodes))]

    @staticmethod
    def _above(form: list, number: dict, own: list[int]) -> list[int]:
        """The strongest mark of each node and those around it."""
        out = list(own)

        def look(n, above):
            k = number[id(n)]
            out[k] = max(above, own[k])
            for c in n[1]:
                look(c, out[k])

        look(form, 0)
        return out

    @staticmethod
    def _root(nodes, number, tags, own, mass, below, holds, article, telling) -> int:
        """The node that is the article."""
        at = 0
        while True:
            kids = [number[id(c)] for c in nodes[at][1]]
            if article[at] or not kids:
                return at
            # Too few pages to tell: names come first, as one page's advert may be longer than its article.
            known = [k for k in kids if holds[k] and not own[k]] or [k for k in kids if not own[k]] if not telling else kids
            best = max(known, key=lambda k: below[k], default=None)
            if best is None or tags[best] in RECORDS:
                return at
            named = holds[best] and not any(holds[k] and k != best for k in kids)
            if not telling and named:
                at = best
                continue
            if not below[best] or own[best] and below[best] < BULK * below[at]:
                return at
            for k in [*kids, at]:
                if k == best:
                    continue
                weight = mass[at] if k == at else below[k]
                hinted_away = k != at and own[k] or named
                if weight > (1 if hinted_away else THIN) * below[best] or weight and tags[k] in HEADINGS and not hinted_away:
                    return at
            at = best


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The article of one page by its host's template; without a template, by the page alone."""
    root, found = parse(page)
    if not found:
        return ""
    filled(root)
    if wrapper and wrapper.words is not None:
        tell(root, wrapper.words)
    form, places = slots(root, wrapper.grain if wrapper else 0)
    if wrapper is None:
        wrapper = Wrapper(grown(form, numbers(places, found, page_mark(found))), 0)
    keep = {i for k, blocks in zip(wrapper.chosen(form), places, strict=True) if k for i in blocks}
    return "\n\n".join(text for i, (_, text, _) in enumerate(found) if i in keep)


def _words(batches):
    """(url, html) -> (host, word, pages, marks): pages that hold a word of classes, ids and roles, and marks of up to 2 * EVIDENCE different ones; the word '' is on every page."""
    open_: dict[tuple, list] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in open_], pa.string()), pa.array([k[1] for k in open_], pa.string()), pa.array([v[0] for v in open_.values()], pa.int64()), pa.array([v[1] for v in open_.values()], pa.list_(pa.int64()))], names=["host", "word", "pages", "marks"])

    for b in batches:
        for url, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            root, found = parse(page.as_py())
            if not found:
                continue
            filled(root)
            name, mark = host_of(url), page_mark(found)
            for word in words_of(root) | {""}:
                kept = open_.setdefault((name, word), [0, []])
                kept[0] += 1
                if len(kept[1]) < 2 * EVIDENCE and mark not in kept[1]:
                    kept[1].append(mark)
            if len(open_) > OPEN_NODES:
                yield out()
                open_ = {}
    if open_:
        yield out()


def _forms(batches):
    """(url, html) -> (host, grain, form, pages, numbers) at each grain, with all words."""
    return _formed((url, page, None) for b in batches for url, page in zip(b.column(0).to_pylist(), b.column(1), strict=True))


def _formed(rows):
    """(url, html, words that tell in its host or None) -> (host, grain, form, pages, numbers): pages with the same tree added up."""
    open_: dict[tuple, list] = {}
    load = 0

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in open_], pa.string()), pa.array([k[1] for k in open_], pa.int32()), pa.array([k[2] for k in open_], pa.string()), pa.array([v[0] for v in open_.values()], pa.int64()), pa.array([json.dumps(v[1]) for v in open_.values()], pa.string())],
            names=["host", "grain", "form", "pages", "numbers"],
        )

    for url, page, words in rows:
        root, found = parse(page.as_py())
        if not found:
            continue
        filled(root)
        name, mark = host_of(url), page_mark(found)
        if words is not None:
            tell(root, words)
        for grain in range(len(GRAINS)) if words is None else [0 if words else 1]:
            form, places = slots(root, grain)
            key, fresh = (name, grain, json.dumps(form)), numbers(places, found, mark)
            if key in open_:
                open_[key][0] += 1
                for x, y in zip(open_[key][1], fresh, strict=True):
                    add(x, y)
            else:
                open_[key] = [1, fresh]
                load += len(fresh)
        if load > OPEN_NODES:
            yield out()
            open_, load = {}, 0
    if open_:
        yield out()


def _part(host, grain, form, pages, given, hashed):
    return pa.RecordBatch.from_arrays(
        [pa.array([host], pa.string()), pa.array([grain], pa.int32()), pa.array([form], pa.string()), pa.array([pages], pa.int64()), pa.array([json.dumps(given)], pa.string()), pa.array([hashed - (1 << 63)], pa.int64())],
        names=["host", "grain", "form", "pages", "numbers", "place"],
    )


def _added(batches):
    """Sorted rows of _forms -> one row a form, with its place: the form's hash less 2 ** 63."""
    key, pages, given = None, 0, []

    def out():
        return _part(*key, pages, given, hash_of(key[2]))

    for b in batches:
        for host, grain, form, n, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if key != (host, grain, form):
                if key is not None:
                    yield out()
                key, pages, given = (host, grain, form), n, json.loads(text)
                continue
            pages += n
            for x, y in zip(given, json.loads(text), strict=True):
                add(x, y)
    if key is not None:
        yield out()


def _folded(batches, bits: int = 0):
    """Rows of _added by host and place -> one such row for each host and leading bits of the hash."""
    key, forms, hashes = None, [], []

    def out():
        template = fold(forms, hashes)
        return _part(key[0], key[1], json.dumps(bare(template)), sum(f[0] for f in forms), [n[2] for n in preorder(template)], key[2] << 64 - bits)

    for b in batches:
        for host, grain, form, n, text, place in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            hashed = place + (1 << 63)
            if key != (host, grain, hashed >> 64 - bits):
                if key is not None:
                    yield out()
                key, forms, hashes = (host, grain, hashed >> 64 - bits), [], []
            forms.append((n, form, json.loads(text)))
            hashes.append(hashed)
    if key is not None:
        yield out()


def _beside(rows: DataFrame, known: DataFrame, of, run, schema: str) -> DataFrame:
    """`run` over groups of (page_id, url, html, what `of` makes of its host's text or None) of all rows. known: a table (host, text, pages).

    The texts of the largest hosts are broadcast up to a size, so a hot host
    moves no pages; pages of the others meet theirs by host and salt.
    """
    sized = known.select("host", "pages", (F.length("text") + F.length("host")).alias("size"))
    fits, room = [], BROADCAST_BYTES
    largest = sized.orderBy(F.desc("pages"), "host").limit(BROADCAST_HOSTS).collect()
    for r in largest:
        room -= r["size"]
        if room < 0:
            break
        fits.append(r["host"])
    hot = rows.sparkSession.createDataFrame([(h,) for h in fits], "host string")
    given = {r["host"]: r["text"] for r in known.join(F.broadcast(hot), "host").select("host", "text").collect()} if fits else {}
    left = len(fits) < len(largest) or len(fits) == BROADCAST_HOSTS
    shared = rows.sparkSession.sparkContext.broadcast(given)

    def here(batches):
        made: dict = {}

        def met(b):
            for i, url, page in zip(b.column(0), b.column(1), b.column(2), strict=True):
                url = url.as_py()
                name = host_of(url)
                if name not in made and name in shared.value:
                    made[name] = of(shared.value[name])
                yield i.as_py(), url, page, made.get(name)

        yield from run(met(b) for b in batches)

    if not left:
        return rows.mapInArrow(lean(here), schema)

    def joined(batches):
        name, own = None, None

        def met(b):
            nonlocal name, own
            for i, url, page, host, text in zip(*(b.column(k) for k in range(5)), strict=True):
                if text.is_valid:
                    name, own = host.as_py(), of(text.as_py())
                    continue
                yield i.as_py(), url.as_py(), page, own if host.as_py() == name else None

        yield from run(met(b) for b in batches)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    keyed = rows.withColumn("host", host)
    first = keyed.join(F.broadcast(hot), "host", "left_semi").select("page_id", "url", "html").mapInArrow(lean(here), schema)
    others = keyed.join(F.broadcast(hot), "host", "left_anti").select("page_id", "url", "html", "host", F.lit(None).cast("string").alias("text"), F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int").alias("salt"))
    theirs = known.join(F.broadcast(hot), "host", "left_anti").select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "text", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # A host's text comes before its pages.
    both = others.unionByName(theirs).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("text").isNull())
    return first.unionByName(both.select("page_id", "url", "html", "host", "text").mapInArrow(lean(joined), schema))


def telling_words(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, text, pages): of each host with text the words of classes, ids and roles, as a JSON list, that EVIDENCE of its different pages or half of them hold."""
    found = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(lean(_words), "host string, word string, pages long, marks array<long>")
    counted = found.groupBy("host", "word").agg(F.sum("pages").alias("pages"), F.size(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("n"))
    counted = cut(counted)
    every = counted.filter("word = ''").select("host", "pages", F.least(F.lit(EVIDENCE), F.ceil(F.col("n") / 2)).alias("least"))
    kept = counted.filter("word <> ''").join(every.select("host", "least"), "host").filter("n >= least").groupBy("host").agg(F.sort_array(F.collect_list("word")).alias("words"))
    return cut(every.join(kept, "host", "left").select("host", F.to_json(F.coalesce("words", F.array().cast("array<string>"))).alias("text"), "pages"))


def induce_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template, pages): one row a host, from all its pages.

    Null, empty and blank html have no tree and take no part; null urls, and
    urls without a host, belong to the host without a name. Repeated rows are
    one page as evidence. Other columns are not read. Empty table: empty result.
    """
    schema = "host string, grain int, form string, pages long, numbers string"
    words = telling_words(pages, url_col, html_col)
    rows = pages.select(F.lit(None).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def formed(groups):
        return _formed((url, page, told or frozenset()) for group in groups for _, url, page, told in group)

    partial = _beside(rows, words, lambda text: frozenset(json.loads(text)), formed, schema)
    dealt = partial.withColumn("salt", F.pmod(F.xxhash64("form"), F.lit(SALTS))).repartition("host", "grain", "salt").sortWithinPartitions("host", "grain", "form").select("host", "grain", "form", "pages", "numbers")
    schema += ", place long"
    forms = cut(dealt.mapInArrow(lean(_added), schema))
    most, bits = forms.groupBy("host").count().agg(F.max("count")).first()[0] or 0, 0
    while most > MAX_FORMS << bits:
        bits += BITS
    # The most forms of a host are merged in parts, by leading bits of their hashes, and the parts by fewer bits.
    while bits:
        # Merging costs time, not bytes: partitions are not to be merged by size.
        n = 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        forms = forms.repartition(n, "host", F.shiftright("place", 64 - bits)).sortWithinPartitions("host", "place").mapInArrow(lean(partial_fold(bits)), schema)
        bits -= BITS
    whole = forms.repartition("host").sortWithinPartitions("host", "place").mapInArrow(lean(_folded), schema)
    text = F.concat(F.lit("["), F.col("grain").cast("string"), F.lit(", ["), "form", F.lit(", "), "numbers", F.lit("], "), "text", F.lit("]"))
    return whole.join(words.select("host", "text"), "host").select("host", text.alias("template"), "pages")


def partial_fold(bits: int):
    return lambda batches: _folded(batches, bits)


def extract_articles(pages: DataFrame, templates: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages`. templates: a table (host, template, pages).

    Null or empty html: empty text. A url without a host belongs to the host
    without a name. Repeated rows are repeated; other columns are not read.
    A host without a template: each page is judged alone. Empty table: empty
    result. The templates of the largest hosts are broadcast up to a size, so
    a hot host moves no pages; pages of the others meet theirs by host and salt.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def wrapper_of(text):
        grain, (form, given), words = json.loads(text)
        return Wrapper(grown(form, given), grain, words)

    def run(groups):
        for group in groups:
            ids, urls, texts = [], [], []
            for i, url, page, wrapper in group:
                ids.append(i)
                urls.append(url)
                texts.append(extract(page.as_py(), wrapper))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return _beside(rows, templates.withColumnRenamed("template", "text"), wrapper_of, run, "page_id long, url string, text string, n_chars long")
