"""Main text of web pages by wrapper induction.

1. Every page is parsed once into its form (the tree of its block elements, runs of like siblings being one repeated
   slot) and its blocks of text, each with its place in the form.
2. A host's template is the union of all forms of its pages, aligned by simple tree matching (the order-preserving
   pairing of children that pairs most nodes). The forms are few; they are merged in two rounds.
3. Over all pages of the host, each slot of the template gets its different texts. A slot whose text stays the same
   is template; what varies is content.
4. The wrapper goes down from the root to the part that holds most of the different text outside links, as long as
   one slot, or slots of one kind, hold it; slots that no page has together are layouts, each with its own part. In that part, constant slots, slots of links, and furniture go.
5. The wrapper is applied to the blocks of every page.

Furniture (navigation, header, footer, aside, form, and elements whose class, id or role says so) is a prior: outside
the main part it weighs less, the less the fewer pages a host has; inside, it goes unless it holds most of the part.
Hosts of fewer than ``least_pages`` different pages are read by their marks alone: article and main.
"""

from __future__ import annotations

import json
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, written
from .dom import BLOCK, RAW, Node, parse

#: Elements without text of their own.
HIDDEN = frozenset("head button select input object embed canvas svg audio video map".split()) | RAW
#: The prior: elements that hold no article, words of class, id or role that mark such parts, and words that may
#: stand beside them in a compound name.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer header menu masthead modal nav navbar navigation newsletter notice notices overlay popup promo promotion promoted "
    "related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets "
    "complementary contentinfo search skip".split()
)
BESIDE_WORDS = frozenset(
    "area bar block bottom box boxes button buttons center col column container content foot global group head holder inner left link links list main "
    "page panel post posts primary reader right row section secondary site slot stories story text top unit user wrap wrapper".split()
)
#: The prior for hosts of few pages: what marks the article.
MAIN_TAGS, MAIN_WORDS = frozenset(["article", "main"]), frozenset(["=main", "=article", "=content", "=main-content"])
#: Elements of text; like siblings of them are one slot. Of others, only longer runs are.
TEXT_TAGS = frozenset("p li dt dd tr td th blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption hr summary details address".split())
RUN = 4
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACE = re.compile(r"\s+")


def is_aside(node: Node, within_main: bool = True) -> bool:
    """By tag or name. Names say nothing of html, body and main, nor of an article outside a main part; a header within a main
    part is the article's own."""
    if node.tag in ASIDE_TAGS and not (node.tag == "header" and within_main):
        return True
    if not node.words or node.tag in ("html", "body", "main") or node.tag == "article" and not within_main:
        return False
    return any(_furniture(name[1:]) for name in node.words if name[0] == "=")


@lru_cache(maxsize=4096)
def _furniture(name: str) -> bool:
    words = [w for w in re.split(r"[_-]+", name) if w and not w.isdigit()]
    return any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in BESIDE_WORDS for w in words)


def is_main(node: Node) -> bool:
    return node.tag in MAIN_TAGS or bool(node.words & MAIN_WORDS)


def _kind(node: Node) -> str:
    return node.tag + "".join(f".{w[1:]}" for w in sorted(node.words) if w[0] == "=")


class Shape(NamedTuple):
    """The form of a subtree: kind, whether it is repeated, children, number of nodes.

    ``shape`` gives equal forms as one object, so they are told apart by identity.
    """

    kind: str
    repeated: bool
    kids: tuple
    size: int

    __eq__ = object.__eq__
    __hash__ = object.__hash__


#: Per worker: forms met, and what was found for pairs of them. Pages of a host share most of their forms.
_SHAPES: dict[tuple, Shape] = {}
_MATCHED: dict[tuple[Shape, Shape], tuple[int, list[tuple[int, int]]]] = {}
_MERGED: dict[tuple[Shape, Shape], Shape] = {}
REMEMBERED = 50_000


def _remember(known: dict, key: tuple, made):
    if len(known) >= REMEMBERED:
        known.clear()
    known[key] = made
    return made


def shape(kind: str, repeated: bool, kids: tuple[Shape, ...]) -> Shape:
    key = (kind, repeated, kids)
    return _SHAPES.get(key) or _remember(_SHAPES, key, Shape(*key, 1 + sum(k.size for k in kids)))


def _deep() -> None:
    """Trees may be as deep as pages are; matching recurses on them in Python alone."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def below(node: Node, among: frozenset[str] | None = None) -> list[Node]:
    """Child elements; with ``among`` the nearest descendants with these tags, hidden elements left out."""
    if among is None:
        return node.elements()
    out, todo = [], node.elements()[::-1]
    while todo:
        n = todo.pop()
        if n.tag in among:
            out.append(n)
        elif n.tag not in HIDDEN:
            todo += n.elements()[::-1]
    return out


def runs(kids: list, kind_of) -> list[list]:
    """Children by slot: like siblings that follow each other are one slot if they are text or many."""
    groups: list[list] = []
    for kid in kids:
        if groups and kind_of(groups[-1][0]) == kind_of(kid):
            groups[-1].append(kid)
        else:
            groups.append([kid])
    out: list[list] = []
    for g in groups:
        tag = kind_of(g[0]).split(".", 1)[0]
        out += [g] if tag in TEXT_TAGS or tag not in BLOCK or len(g) > RUN else [[k] for k in g]
    return out


def skeleton(node: Node, known: dict[int, Shape] | None = None, among: frozenset[str] | None = None) -> Shape:
    """The form of a tree; like siblings of one slot are one, with the children of all of them
    matched together. ``known`` takes the form of every element below, by id()."""
    known = {} if known is None else known
    todo = [(node, None)]
    while todo:
        n, kids = todo.pop()
        if kids is None:
            kids = below(n, among)
            todo.append((n, kids))
            todo += [(k, None) for k in kids]
            continue
        made = []
        for group in runs(kids, lambda k: known[id(k)].kind):
            one = known[id(group[0])]
            for other in group[1:]:
                both = merge(one, known[id(other)])
                one = shape(both.kind, True, both.kids)
            made.append(one)
        known[id(n)] = shape(_kind(n), False, tuple(made))
    return known[id(node)]


def matching(a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two forms: matched nodes, and the pairs of the roots' children."""
    if a is b:
        return a.size, [(i, i) for i in range(len(a.kids))]
    if a.kind != b.kind:
        return 0, []
    return _MATCHED.get((a, b)) or _remember(_MATCHED, (a, b), _match(a.kids, b.kids))


def _match(left: tuple[Shape, ...], right: tuple[Shape, ...]) -> tuple[int, list[tuple[int, int]]]:
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(right):
            paired = above[j] + matching(x, y)[0] if x.kind == y.kind else 0
            row[j + 1] = max(paired, above[j + 1], row[j])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return 1 + best[-1][-1], pairs[::-1]


def merge(a: Shape, b: Shape) -> Shape:
    """The union of two forms of one kind, aligned by simple tree matching."""
    if a is b:
        return a
    return _MERGED.get((a, b)) or _remember(_MERGED, (a, b), _union(a, b))


def _union(a: Shape, b: Shape) -> Shape:
    kids: list[Shape] = []
    i = j = 0
    for x, y in [*matching(a, b)[1], (len(a.kids), len(b.kids))]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            kids.append(merge(a.kids[x], b.kids[y]))
        i, j = x + 1, y + 1
    return shape(a.kind, a.repeated or b.repeated, tuple(kids))


def _first_kids(form: Shape, slot: int) -> list[int]:
    """Slots of a node's children: nodes are numbered from the root on, each before those below it."""
    out, at = [], slot + 1
    for k in form.kids:
        out.append(at)
        at += k.size
    return out


def align(page: Node, template: Shape, among: frozenset[str] | None = None, known: dict[int, Shape] | None = None) -> Iterator[tuple[Node, int, bool]]:
    """(element, slot, repeated) of every element of the page that has a place in the template."""
    if known is None:
        known = {}
        skeleton(page, known, among)
    todo = [(page, template, 0)]
    while todo:
        node, place, slot = todo.pop()
        yield node, slot, place.repeated
        groups = runs(below(node, among), lambda k: known[id(k)].kind)
        if not groups:
            continue
        firsts = []
        for g in groups:
            one = known[id(g[0])]
            for other in g[1:]:
                one = merge(one, known[id(other)])
            firsts.append(one)
        at = _first_kids(place, slot)
        for i, j in matching(shape(place.kind, False, tuple(firsts)), place)[1]:
            todo += [(child, place.kids[j], at[j]) for child in groups[i]]


def slots_of(form: Shape, template: Shape) -> list[int]:
    """The template's slot of each node of a form, -1 where it has none."""
    out = [-1] * form.size
    todo = [(form, 0, template, 0)]
    while todo:
        a, i, b, j = todo.pop()
        out[i] = j
        left, right = _first_kids(a, i), _first_kids(b, j)
        todo += [(a.kids[x], left[x], b.kids[y], right[y]) for x, y in matching(a, b)[1]]
    return out


def written_form(form: Shape) -> str:
    """A form as text: its nodes in order, each with its kind, whether it is repeated, and its number of children."""
    out, todo = [], [form]
    while todo:
        f = todo.pop()
        out += [f.kind, int(f.repeated), len(f.kids)]
        todo += f.kids[::-1]
    return json.dumps(out, separators=(",", ":"))


def read_form(text: str) -> Shape:
    flat = json.loads(text)
    made: list[Shape] = []
    for at in range(len(flat) - 3, -1, -3):
        kind, repeated, n = flat[at : at + 3]
        kids = tuple(made[: -n - 1 : -1]) if n else ()
        del made[len(made) - n :]
        made.append(shape(kind, bool(repeated), kids))
    return made[0]


class Block(NamedTuple):
    """A block of a page's text: the node of the form it lies in, its text, how much of it are links, whether the
    prior calls it furniture, and whether it lies in a part that is marked as the article."""

    node: int
    text: str
    links: int
    aside: bool
    main: int


def read_page(source: str) -> tuple[str, list[Block]]:
    """The form of a page and its blocks in order."""
    _deep()
    root = parse(source)
    known: dict[int, Shape] = {}
    form = skeleton(root, known, BLOCK)
    place = {id(n): slot for n, slot, _ in align(root, form, BLOCK, known)}
    out: list[Block] = []
    inline: list[str] = []
    links = 0

    def flush(at: tuple[int, bool, int]) -> None:
        nonlocal links
        text = _SPACE.sub(" ", "".join(inline)).strip()
        inline.clear()
        if text:
            out.append(Block(at[0], text, min(links, len(text)), at[1], at[2]))
        links = 0

    # One entry for each open element: its children left to see, the place of its text, whether it is a link.
    todo = [(iter(root.kids), (0, False, 0), False)]
    while todo:
        kids, at, link = todo[-1]
        kid = next(kids, None)
        if kid is None:
            if len(todo) == 1 or todo[-2][1] != at:
                flush(at)
            todo.pop()
        elif isinstance(kid, str):
            inline.append(kid)
            links += len(kid) if link else 0
        elif kid.tag == "br":
            inline.append(" ")
        elif kid.tag not in HIDDEN:
            aside = is_aside(kid, at[2] > 0)
            if kid.tag in BLOCK:
                flush(at)
                main = 0 if aside else 2 if kid.tag == "article" else max(at[2], int(is_main(kid)))
                todo.append((iter(kid.kids), (place.get(id(kid), -1), aside or at[1], main, id(kid)), False))
            elif not aside:
                todo.append((iter(kid.kids), at, link or kid.tag == "a"))
    return written_form(form), out


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_READ = "page_id long, url string, host string, form string, longest long, node array<int>, text array<string>, links array<int>, aside array<boolean>, main array<int>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
    for block in blocks(batches, "html"):
        rows: tuple[list, ...] = ([], [], [], [], [], [], [])
        for source in block.column("html").to_pylist():
            form, found = read_page(source)
            columns = [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in Block._fields]
            for to, x in zip(rows, (form, _digest(max(columns[1], key=len, default="")), *columns), strict=True):
                to.append(x)
        yield pa.RecordBatch.from_arrays(
            [*(block.column(c) for c in ("page_id", "url", "host")), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))],
            names=["page_id", "url", "host", "form", "longest", *Block._fields],
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One form for each host, of forms that come sorted by host."""
    _deep()
    host, made = None, None
    done: list[tuple[str, str]] = []
    for batch in batches:
        for h, text in zip(batch.column("host").to_pylist(), batch.column("form").to_pylist(), strict=True):
            form = read_form(text)
            if h == host:
                made = merge(made, form)
                continue
            if made is not None:
                done.append((host, written_form(made)))
            host, made = h, form
        yield _forms(done)
        done = []
    if made is not None:
        yield _forms([(host, written_form(made))])


def _forms(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["host", "form"])


def induce_templates(read: DataFrame) -> DataFrame:
    """(host, template) from all forms of each host's pages: merged in shares of a hash, so that no task has all forms
    of a large host, then the shares' templates."""
    forms = read.select("host", "form").distinct()
    share = F.pmod(F.xxhash64("form"), F.lit(64))
    some = forms.repartition("host", share).sortWithinPartitions("host", "form").mapInArrow(_merged, "host string, form string")
    all_ = some.repartition("host").sortWithinPartitions("host", "form").mapInArrow(_merged, "host string, form string")
    return all_.withColumnRenamed("form", "template")


class Aligned:
    """Slots of the nodes of a form in a host's template, remembered: pages of a host share most forms."""

    def __init__(self):
        _deep()
        self.forms: dict[str, Shape] = {}
        self.slots: dict[tuple[str, str], list[int]] = {}

    def form(self, text: str) -> Shape:
        return self.forms.get(text) or _remember(self.forms, text, read_form(text))

    def __call__(self, form: str, template: str) -> list[int]:
        return self.slots.get((form, template)) or _remember(self.slots, (form, template), slots_of(self.form(form), self.form(template)))


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each slot of each page; ``nth`` marks the only, first or last block of the slot in the page with 0, 1
    or 2, the others with 3."""
    slots = Aligned()
    names = ["host", "slot", "nth", "said", "size", "links", "aside", "page"]
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    for batch in batches:
        rows: tuple[list, ...] = tuple([] for _ in names)
        for host, template, form, longest, node, text, links, aside in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "form", "longest", *Block._fields[:-1])), strict=True):
            at = slots(form, template)
            place = [at[n] if n >= 0 else -1 for n in node]
            nth = numbered(place)
            page = [longest if x < 3 else 0 for x in nth]
            for row in zip([host] * len(node), place, nth, map(_digest, text), map(len, text), links, aside, page, strict=True):
                for to, x in zip(rows, row, strict=True):
                    to.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)


def numbered(place: list[int]) -> list[int]:
    """For each block of a page: 0 if it is the only one of its slot, 1 the first, 2 the last, 3 any other."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, p in enumerate(place):
        first.setdefault(p, i)
        last[p] = i
    return [0 if first[p] == last[p] else 1 if first[p] == i else 2 if last[p] == i else 3 for i, p in enumerate(place)]


class Wrapper:
    """A host's template with what is known of its slots. ``stats``: slot, mass (size of the different texts), links (in links),
    aside (of what is furniture), pages (that have it)."""

    def __init__(self, template: Shape, stats: list[dict], pages: int, prior: float = 8.0):
        n = template.size
        self.shapes, self.kids, up = [template] * n, [[] for _ in range(n)], [-1] * n
        todo = [(template, 0)]
        while todo:
            form, slot = todo.pop()
            self.shapes[slot], self.kids[slot] = form, _first_kids(form, slot)
            for k, at in zip(form.kids, self.kids[slot], strict=True):
                up[at] = slot
                todo.append((k, at))
        self.up = up
        self.total, self.linked, self.furniture, self.own, self.pages = ([0.0] * n for _ in range(5))
        self.uses, self.texts = [0.0] * n, [0.0] * n
        discount = pages / (pages + prior)
        strict = [0.0] * n
        for s in stats:
            at = s["slot"]
            self.total[at], self.linked[at], self.furniture[at], self.pages[at] = s["mass"], s["links"], s["aside"], s["pages"]
            self.uses[at], self.texts[at] = s["uses"], s["texts"]
            self.own[at] = max(0.0, s["mass"] - s["links"] - (1 - discount) * s["aside"])
            strict[at] = max(0.0, s["mass"] - s["links"] - s["aside"])
        self.free = list(self.own)
        #: Own and free text by all names, and by names as far as the host's pages bear them out.
        self.strict = (strict, list(strict))
        for at in range(n - 1, 0, -1):
            for x in (self.total, self.linked, self.furniture, self.free, self.strict[1], self.uses, self.texts):
                x[up[at]] += x[at]
            self.pages[up[at]] = max(self.pages[up[at]], self.pages[at])

    def tag(self, slot: int) -> str:
        return self.shapes[slot].kind.split(".", 1)[0]

    def layouts(self, slot: int) -> list[list[int]]:
        """The children with text, in groups that stand together in pages; different layouts are groups of their own."""
        left = sorted((k for k in self.kids[slot] if self.free[k] > 0), key=lambda k: -self.free[k])
        out = []
        while left:
            most = left[0]
            group = [k for k in left if k == most or self.pages[k] + self.pages[most] > self.pages[slot]]
            out.append(group)
            left = [k for k in left if k not in group]
        return out

    def holder(self, group: list[int], least: float) -> list[int]:
        """The slot, or the slots of one kind, that hold at least ``least``; none if there are none."""
        if self.free[group[0]] >= least:
            return group[:1]
        kinds = defaultdict(list)
        for k in group:
            if self.shapes[k].kind not in ("div", "section"):
                kinds[self.shapes[k].kind].append(k)
        found = max(kinds.values(), key=lambda g: sum(self.free[k] for k in g), default=[])
        return found if sum(self.free[k] for k in found) >= least else []

    def main(self, slot: int = 0, hold: float = 0.6) -> list[int]:
        """The slots of the main part, below each other nowhere."""
        done: list[int] = []
        todo = [slot]
        while todo:
            at = todo.pop()
            groups = self.layouts(at)
            if not groups:
                done.append(at)
            for group in groups:
                whole = sum(self.free[k] for k in group) + (self.own[at] if len(groups) == 1 else 0)
                holds = self.holder(group, hold * whole)
                # Text elements are no part of their own; below what holds its text directly there is none either.
                if not holds or any(self.tag(k) in TEXT_TAGS for k in holds):
                    done += group if len(groups) > 1 else [at]
                elif len(holds) > 1 or self.own[holds[0]] > 0.5 * self.free[holds[0]]:
                    done += holds
                else:
                    todo += holds
        return sorted(set(done))

    def below(self, slot: int) -> range:
        return range(slot, slot + self.shapes[slot].size)

    def marked(self, slot: int) -> bool:
        return self.furniture[slot] > 0.5 * self.total[slot]

    def chosen(self, least: float = 0.05) -> list[int]:
        """The main parts. One that is mostly marked as furniture, such as many long comments, gives way to an unmarked part of
        the same pages that has ``least`` of its text, however many pages the host has."""
        found = self.main()
        if not any(map(self.marked, found)):
            return found
        own, free = self.own, self.free
        self.own, self.free = self.strict
        other = [s for s in self.main() if self.free[s] > 0]
        together = lambda c, s: self.free[s] >= least * (self.total[c] - self.linked[c]) and self.pages[c] + self.pages[s] > self.pages[0]
        kept = [c for c in found if not self.marked(c) or not any(together(c, s) for s in other)]
        if kept == found:
            self.own, self.free = own, free
            return found
        return sorted({*other, *(c for c in kept if self.marked(c))})

    def link_lists(self, chosen: int, most_links: float) -> set[int]:
        """Parts of links below a slot that are no part of its text: all that stand at its edge or say the same on most pages. A
        list of links with the article's text before and after it, such as its sources, stays."""
        slots = self.below(chosen)[1:]
        heavy = [k for k in slots if (self.shapes[k].size > 1 or self.shapes[k].repeated) and self.linked[k] > most_links * self.total[k] and self.free[k] < 0.5 * self.free[chosen]]
        within = {x for k in heavy for x in self.below(k)}
        plain = [k for k in slots if self.own[k] > 0 and k not in within]
        first, last = (min(plain), max(plain)) if plain else (0, 0)
        inner = lambda k: first < k < last and not self.marked(k) and self.texts[k] > 0.5 * self.uses[k]
        return {k for k in heavy if not inner(k)}

    def kept(self, most_links: float = 0.6) -> set[int]:
        """Slots whose text is the article's, unless it is constant."""
        out: set[int] = set()
        for chosen in self.chosen():
            out.update(self.below(chosen))
            lists = self.link_lists(chosen, most_links)
            for slot in self.below(chosen)[1:]:
                links = slot in lists
                furniture = self.furniture[slot] > 0.5 * self.total[slot] and self.free[slot] < 0.8 * self.free[chosen]
                if self.total[slot] and (links or furniture):
                    out.difference_update(self.below(slot))
            # Headings that stand before the part on the way down belong to it.
            at = chosen
            while at > 0:
                out.update(k for k in self.kids[self.up[at]] if k < at and self.tag(k) in HEADINGS and not self.furniture[k])
                at = self.up[at]
        return out


def _wrappers(least_pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            kept: list[list[int]] = []
            fixed: list[list[dict]] = []
            for template, pages, stats, said in zip(*(batch.column(c).to_pylist() for c in ("template", "pages", "stats", "fixed")), strict=True):
                wrapper = Wrapper(read_form(template), stats or [], pages)
                kept.append(sorted(wrapper.kept()) if pages >= least_pages else [])
                own = set(kept[-1])
                fixed.append([x for x in said or [] if x["slot"] in own and wrapper.tag(x["slot"]) not in HEADINGS])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("template"), pa.array(kept, pa.list_(pa.int32())), pa.array(fixed, batch.schema.field("fixed").type)], names=["host", "template", "kept", "fixed"]
            )

    return run


def by_marks(main: list[int], aside: list[bool]) -> list[bool]:
    """Which blocks of a page are kept by its marks alone: those of its articles, else of its main part, else all that
    is no furniture."""
    for least in (2, 1):
        found = [m >= least and not a for m, a in zip(main, aside, strict=True)]
        if any(found):
            return found
    return [not a for a in aside]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = Aligned()
    wrappers: dict[str, tuple[set[int], set]] = {}
    for batch in batches:
        texts = []
        for host, template, form, node, text, aside, main, kept, fixed in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "form", "node", "text", "aside", "main", "kept", "fixed")), strict=True):
            known = False
            if kept:
                inside, constant = wrappers.get(host) or _remember(wrappers, host, (set(kept), {(f["slot"], f["nth"], f["said"]) for f in fixed or ()}))
                at = slots(form, template)
                known = any(slot in inside for slot in at)
                place = [at[n] if n >= 0 else -1 for n in node]
                keep = [p in inside for p in place]
                if constant:
                    keep = [k and (p, n, _digest(t)) not in constant for k, p, n, t in zip(keep, place, numbered(place), text, strict=True)]
            if not known:  # no wrapper, or a layout that it has no part of
                keep = by_marks(main, aside)
            texts.append(" ".join(t for t, k in zip(text, keep, strict=True) if k))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, constant_share: float = 0.95, least_pages: int = 3, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if none).

    A null html is empty; a null url has the empty host; repeated rows and null ids stay; an empty table gives an empty result;
    pages of any length and depth are handled alike. Pages whose longest blocks are equal count as one, so copies do not turn an
    article into a template; hosts of fewer than ``least_pages`` different pages are read by their marks. A slot's only, first
    or last block is template if one text fills it on at least ``constant_share`` of the host's different pages that have it,
    of which there must be three at least; headings never are. Templates are broadcast only if all of them together take no more
    than ``broadcast_bytes``; else they are joined by host.
    """
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    read = written(source.mapInArrow(_read, _READ), "pages")
    templates = written(induce_templates(read), "templates")
    size = templates.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0

    def joined(df: DataFrame, small: DataFrame, bytes_: int) -> DataFrame:
        return df.join(F.broadcast(small) if bytes_ <= broadcast_bytes else small, "host", "left")

    said = joined(read, templates, size).mapInArrow(_said, "host string, slot int, nth int, said long, size long, links long, aside boolean, page long")
    texts = said.groupBy("host", "slot", "nth", "said", "page").agg(*(F.max(c).alias(c) for c in ("size", "links", "aside")))
    texts = texts.groupBy("host", "slot", "nth", "said").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("size", "links", "aside")))
    texts = written(texts, "slots")
    sums = texts.groupBy("host", "slot").agg(
        F.sum("size").alias("mass"), F.sum("links").alias("links"), F.sum(F.when(F.col("aside"), F.col("size")).otherwise(0)).alias("aside"),
        F.sum(F.when(F.col("nth") < 2, F.col("n")).otherwise(0)).alias("pages"),
        F.sum(F.when(F.col("nth") < 3, F.col("n")).otherwise(0)).alias("uses"), F.count_if(F.col("nth") < 3).alias("texts"),
    )
    stats = sums.where("slot >= 0").groupBy("host").agg(F.collect_list(F.struct("slot", "mass", "links", "aside", "pages", "uses", "texts")).alias("stats"))
    counts = read.groupBy("host").agg(F.count_distinct("longest").alias("pages"))
    share = texts.where("nth < 3 and slot >= 0").groupBy("host", "slot", "nth").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "said")).alias("top"))
    constant = share.where((F.col("pages") >= 3) & (F.col("top.n") >= constant_share * F.col("pages")))
    fixed = constant.groupBy("host").agg(F.collect_list(F.struct("slot", "nth", F.col("top.said").alias("said"))).alias("fixed"))
    together = templates.join(counts, "host").join(stats, "host", "left").join(fixed, "host", "left")
    kinds = "host string, template string, kept array<int>, fixed array<struct<slot:int,nth:int,said:bigint>>"
    wrappers = written(together.mapInArrow(_wrappers(least_pages), kinds), "wrappers")
    out = joined(read, wrappers, 3 * size).select("page_id", "url", "host", "template", "form", "node", "text", "aside", "main", "kept", "fixed")
    return out.mapInArrow(_texts, "page_id long, url string, text string")
