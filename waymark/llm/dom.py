"""A small tolerant HTML tree: elements, merged text, implied ends of elements."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these names, up to the nearest of the bounds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    """An element: its tag, the words of class, id and role (whole names marked by '='), and children
    (nodes and strings)."""

    __slots__ = ("kids", "tag", "words")

    def __init__(self, tag: str, words: frozenset[str] = frozenset()):
        self.tag, self.words, self.kids = tag, words, []

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]


@lru_cache(maxsize=4096)
def _attribute_words(text: str) -> frozenset[str]:
    if "=" not in text:
        return frozenset()
    found = " ".join("".join(m.groups("")[1:]) for m in _NAMES.finditer(text))
    names = found.lower().split()
    return frozenset(w for w in re.split(r"[\s_-]+", " ".join(names)) if w) | {f"={n}" for n in names}


def parse(source: str) -> Node:
    """The tree of a page, however deep; text outside any element hangs below the root."""
    root = Node("#root")
    stack, at = [root], 0
    opened: Counter[str] = Counter()
    while True:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                stack[-1].kids.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            while opened[tag] and (closed := stack.pop().tag):
                opened[closed] -= 1
                if closed == tag:
                    break
            continue
        ended, bounds = ENDS.get(tag, ((), ()))
        if tag in BLOCK and opened["p"]:
            _end(stack, opened, ("p",), ("button", "table", "td", "th", "object"))
        if any(opened[t] for t in ended):
            _end(stack, opened, ended, bounds)
        node = Node(tag, _attribute_words(m.group(3)))
        stack[-1].kids.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            node.kids.append(source[at : close.start() if close else len(source)])
            at = close.end() if close else len(source)
            continue
        stack.append(node)
        opened[tag] += 1


def _end(stack: list[Node], opened: Counter[str], names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in bounds:
            return
        if stack[i].tag in names:
            opened.subtract(n.tag for n in stack[i:])
            del stack[i:]
            return
