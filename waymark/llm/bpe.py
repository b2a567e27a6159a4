"""BPE encoding and decoding with a word-end vocabulary, by dynamic programming over prefixes.

The symbols of a word are its bytes, the last one marked as the word's end. For every prefix
there is exactly one token that can end its encoding: among the tokens that are suffixes of the
prefix (matches of a suffix-link automaton over the vocabulary), it is the one that is compatible
with the last token of the prefix before it, which means that the merges would not have joined
the two otherwise. Following the tokens back from the end gives the exact ids, as the merges in order
of rank would.

The different words of a block are encoded together, in numpy: one step takes all words' next symbol.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import blocks, narrow

#: Fixed values of the vocabulary: white space, short forms that are words of their own, the mark of a word's end. Other words are runs
#: of letters, single digits and runs of other characters.
SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SHORT_FORMS = ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll")
END = "</w>"
#: More than the number of symbols; pairs of tokens that a worker remembers.
STEP, REMEMBER = 1 << 16, 300_000
#: Slots (as a power of two) for pairs met of late; words from which a step over all of them is worth its fixed cost.
SLOTS, MANY = 20, 50
#: Kinds of characters. Special tokens are replaced by surrogates, which no text holds, from MARK on.
BLANK, LETTER, DIGIT, OTHER, SPECIAL, LATE = 0, 1, 2, 3, 4, 8
MARK = 0xD800
#: Where the library's versions of Unicode differ from that of Python (15.1): letters and digits of 16; lower case of 16 and 17 (first and
#: last character, distance); characters after 10, which do not compose and stay in their place (marks, and U+11930).
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEW_LOWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
UNMOVED = "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
#: Characters of a long text that are worked on at a time; such a span ends where no word and no composed character goes on.
SPAN = 1 << 19
LOWER = {i: i + by for first, last, by in NEW_LOWER for i in range(first, last + 1)}
SPAN_END = regex.compile(r"[ \t\n\r]|[.,;:!?、。](?=[A-Za-zА-яぁ-ゖァ-ヺ一-龥가-힣])")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free
    one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + other.index(b)) for b in range(256)]


class PrefixEncoder:
    """Ids of single words under a BPE vocabulary whose ids rise in order of merging."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.names = {i: t for t, i in vocab.items()}
        self.join: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for a, b in merges:
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.join.setdefault(pair, whole)
            self.parts.setdefault(whole, pair)
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + END] for s in symbols]
        self.spelled: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.final)}
        for whole, (a, b) in self.parts.items():
            self.spelled[whole] = self.spelled[a] + self.spelled[b]
        self._automaton()
        self.size = array("i", (len(self.spelled.get(i, ())) for i in range(max(self.spelled) + 1)))
        self._tables()
        del self.spelled
        self.known: dict[int, bool] = {}
        self.recent = np.full(1 << SLOTS, -1, np.int64)  # pair of tokens * 2 + whether they stay apart

    def _automaton(self) -> None:
        """Trie of the tokens' symbols with suffix links; each node knows its own token and the next
        node up the suffix links that has one."""
        self.go: dict[int, int] = {}  # node * STEP + symbol -> node
        token, kids = [-1], [[]]
        for i, spelled in self.spelled.items():
            node = 0
            for s in spelled:
                to = self.go.get(node * STEP + s)
                if to is None:
                    to = self.go[node * STEP + s] = len(token)
                    kids[node].append((s, to))
                    token.append(-1)
                    kids.append([])
                node = to
            token[node] = i
        link, shorter = [0] * len(token), [0] * len(token)
        queue = deque(to for _, to in kids[0])
        while queue:
            node = queue.popleft()
            for s, to in kids[node]:
                up = link[node]
                while up and up * STEP + s not in self.go:
                    up = link[up]
                link[to] = self.go.get(up * STEP + s, 0)
                queue.append(to)
            up = link[node]
            shorter[node] = up if token[up] >= 0 else shorter[up]
        self.token, self.link, self.shorter = array("i", token), array("i", link), array("i", shorter)

    def _tables(self) -> None:
        """The automaton as tables: from a node by an inner byte to the next node, and by a last byte to the longest token that
        ends there; the longest token of a node; the next shorter one of a token. Only nodes of inner symbols are numbered."""
        token, link, shorter = (np.array(x) for x in (self.token, self.link, self.shorter))
        edges = np.array([(k // STEP, k % STEP, to) for k, to in self.go.items()])
        byte = np.full(STEP, -1)
        byte[self.inner] = np.arange(256)
        last = np.full(STEP, -1)
        last[self.final] = np.arange(256)
        inner = byte[edges[:, 1]] >= 0
        row = np.full(len(token), -1)
        row[0] = 0
        row[edges[inner, 2]] = np.arange(1, inner.sum() + 1)
        longest = np.where(token >= 0, token, token[shorter])
        kind = np.uint16 if max(inner.sum(), token.max()) < 1 << 16 else np.uint32
        self.next = np.zeros((inner.sum() + 1, 256), kind)
        self.ending = np.zeros((inner.sum() + 1, 256), kind)
        level, parent = np.array([0]), edges[:, 0]
        while len(level):
            if level[0]:
                self.next[row[level]], self.ending[row[level]] = self.next[row[link[level]]], self.ending[row[link[level]]]
            own = np.isin(parent, level)
            for at, table, of, what in ((own & inner, self.next, byte, row), (own & ~inner, self.ending, last, longest)):
                table[row[parent[at]], of[edges[at, 1]]] = what[edges[at, 2]]
            level = edges[own & inner, 2]
        self.longest = np.zeros(len(self.next), np.int32)
        self.longest[row[row >= 0]] = longest[row >= 0]
        self.fewer = np.full(len(self.size), len(self.size), np.int32)  # none: an index error, if it were ever asked for
        self.fewer[token[token >= 0]] = np.where(shorter > 0, token[shorter], len(self.size))[token >= 0]
        self.sizes = np.array(self.size, np.int32)

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs."""
        key = left.astype(np.int64) * STEP + right
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
        held = self.recent[slot]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            pairs, first, of = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self.compatible(k // STEP, k % STEP) for k in pairs.tolist()])
            self.recent[slot[new[first]]] = pairs * 2 + found
            out[new] = found[of]
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` apart where they meet.

        The two are unmade in turn, latest merge first. If at some time the facing parts could be
        joined by a merge that comes before the merges that hid them, the pair would not have
        come to be.
        """
        key = left * STEP * STEP + right
        found = self.known.get(key)
        if found is None:
            found = self._apart(left, right)
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[key] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        # A facing pair joined by merge x is wrong if x would have come before both facing parts
        # were swallowed: before the merge that took the left part (on its right end) and the
        # one that took the right part. A tie goes to the leftmost place.
        left_until, right_until = 1 << 60, 1 << 60
        while True:
            joined = self.join.get((left, right))
            if joined is not None and joined < left_until and joined <= right_until:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left >= right):
                left_until, left = left, a[1]
            else:
                right_until, right = right, b[0]

    def encode(self, word: bytes) -> array:
        last, node = array("i", [-1]) * len(word), 0
        go, link, token, shorter, size, known = self.go.get, self.link, self.token, self.shorter, self.size, self.known.get
        for at, b in enumerate(word):
            s = self.inner[b] if at < len(word) - 1 else self.final[b]
            to = go(node * STEP + s)
            while to is None and node:
                node = link[node]
                to = go(node * STEP + s)
            node = to or 0
            match = node if token[node] >= 0 else shorter[node]
            while match:
                t = token[match]
                before = at - size[t]
                if before < 0:
                    last[at] = t
                    break
                left = last[before]
                if left >= 0:
                    apart = known(left * STEP * STEP + t)
                    if self.compatible(left, t) if apart is None else apart:
                        last[at] = t
                        break
                match = shorter[match]
        out, at = array("i"), len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]

    def encode_all(self, letters: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that ``cuts`` marks in ``letters``, one word after the other, and where each word's begin.

        Words longer than ``MANY`` others are too few for steps and go one by one.
        """
        length = np.diff(cuts)
        most = np.partition(length, -MANY)[-MANY] if len(length) >= MANY else 0
        order = np.flatnonzero(length <= most)
        order = order[np.argsort(-length[order], kind="stable")]  # those that go on are the first ones
        long = {i: self.encode(letters[cuts[i] : cuts[i + 1]].tobytes()) for i in np.flatnonzero(length > most).tolist()}
        own, begin = length[order], cuts[order]
        going = len(order) - np.cumsum(np.bincount(own, minlength=1))  # words of over 0, 1, 2 ... bytes
        base = np.concatenate([[0], np.cumsum(going)])  # where a step's tokens begin
        last, node = np.zeros(base[-1], np.int32), np.zeros(len(order), np.int64)
        for at, (now, on) in enumerate(zip(going[:-1].tolist(), going[1:].tolist())):
            by = node[:now] * 256 + letters[begin[:now] + at]
            node[:on] = self.next.ravel()[by[:on]]
            t = np.concatenate([self.longest[node[:on]], self.ending.ravel()[by[on:]].astype(np.int32)])
            who = np.arange(now)
            while len(who):
                before = at - self.sizes[t]
                fits = before < 0
                rest = np.flatnonzero(~fits)
                fits[rest] = self.apart(last[base[before[rest]] + who[rest]], t[rest])
                last[base[at] + who[fits]] = t[fits]
                who, t = who[~fits], self.fewer[t[~fits]]
        count, rounds = np.zeros(len(length), np.int64), []
        who, at = np.arange(len(order)), own - 1
        while len(who):
            t = last[base[at] + who]
            rounds.append((order[who], t))
            count[order[who]] += 1
            at = at - self.sizes[t]
            who, at = who[at >= 0], at[at >= 0]
        for i, ids in long.items():
            count[i] = len(ids)
        edge = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(edge[-1], np.uint32)
        for k, (words, t) in enumerate(rounds, 1):
            out[edge[words + 1] - k] = t
        for i, ids in long.items():
            out[edge[i] : edge[i + 1]] = ids
        return out, edge


def code_points(ranges: str) -> list[int]:
    """Code points of ranges in hexadecimal."""
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return [i for r in ends for i in range(r[0], r[-1] + 1)]


def character_kinds() -> np.ndarray:
    """The kind of every code point; LATE is added where ``_exact`` may differ from ``_normal``."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kind_of = {"L": LETTER, "N": DIGIT}
    kinds[:0x40000] = [kind_of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x40000)]
    kinds[code_points(NEW_LETTERS)], kinds[code_points(NEW_DIGITS)] = LETTER, DIGIT
    kinds[[ord(c) for c in regex.findall(SPACE, "".join(map(chr, range(0x4000))))]] = BLANK
    kinds[MARK:0xE000] = SPECIAL
    # U+11938 is what U+11930 composes to.
    kinds[[*LOWER, *code_points(UNMOVED), 0x11938]] |= LATE
    return kinds


def filled(kind: pa.DataType, cuts, data: pa.Buffer) -> pa.Array:
    """Texts or bytes that lie one after the other in ``data``."""
    return pa.Array.from_buffers(kind, len(cuts) - 1, [None, pa.py_buffer(np.asarray(cuts).astype(np.int32)), data])


class WordBpe:
    """Whole texts: normalising, splitting into words, ids and tokens. Each different word of a block is encoded once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.words = PrefixEncoder(spec["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = self.words.names | {i: s for s, i in self.special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)])
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        self.marks = {s: chr(MARK + i) for i, s in enumerate(self.special)}
        self.kinds = character_kinds()
        self.unmoved = regex.compile(f"([{''.join(map(chr, code_points(UNMOVED)))}])")

    def _normal(self, text: str) -> str:
        """The normalised text by Python's tables; neither composing nor lower-casing reaches over a mark."""
        if any(s in text for s in self.special):
            text = self.cut.sub(lambda m: self.marks[m.group()], text)
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def _exact(self, text: str) -> str:
        """The normalised text by the library's tables."""
        return "".join([self._normal(part) for part in self.unmoved.split(text)]).translate(LOWER)

    def _starts(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character."""
        starts = np.ones(len(kinds), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        starts |= (kinds == DIGIT) | (kinds == SPECIAL)
        starts &= kinds != BLANK
        quotes = np.flatnonzero((points == ord("'")) & starts)
        for form in SHORT_FORMS:
            at = quotes[quotes + len(form) <= len(points)]
            for i, c in enumerate(form):
                at = at[points[at + i] == ord(c)]
            starts[at + 1] = False
            after = at + len(form)
            after = after[after < len(points)]
            starts[after] = kinds[after] != BLANK
        return starts

    def _characters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, code points and kinds of the texts with a space between them."""
        text = " ".join(texts)
        letters = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        points = letters if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return letters, points, self.kinds[points]

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin. The strings of special tokens become their ids."""
        normal = [self._normal(t) for t in texts]
        letters, points, kinds = self._characters(normal)
        if (kinds >= LATE).any():
            normal = [self._exact(t) for t in texts]
            letters, points, kinds = self._characters(normal)
            kinds &= LATE - 1
        starts = self._starts(points, kinds)
        first = np.flatnonzero(starts)
        edge = np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in normal)]))
        marked = np.flatnonzero(kinds[first] == SPECIAL)
        marks = points[first[marked]].astype(np.int64) - MARK
        # Words without the white space between them.
        keep = kinds != BLANK
        if points is not letters:
            width = 1 + (points > 0x7F).view(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
            keep, starts = np.repeat(keep, width), np.repeat(starts, width) & ((letters & 0xC0) != 0x80)
        letters, starts = letters[keep], starts[keep]
        words = filled(pa.binary(), np.append(np.flatnonzero(starts), len(letters)), pa.py_buffer(letters)).dictionary_encode()
        _, cuts, letters = words.dictionary.buffers()
        cuts = np.frombuffer(cuts, np.int32)[: len(words.dictionary) + 1].astype(np.int64)
        flat, begin = self.words.encode_all(np.frombuffer(letters or b"", np.uint8), cuts)
        code = words.indices.to_numpy().astype(np.int64)
        code[marked] = len(begin) - 1 + marks
        flat = np.concatenate([flat, np.fromiter(self.special.values(), np.uint32)])
        begin = np.concatenate([begin, begin[-1] + 1 + np.arange(len(self.special))])
        size = np.diff(begin)[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.arange(total) + np.repeat(begin[code] - ends + size, size)], np.concatenate([[0], ends])[edge]

    def decode(self, ids: np.ndarray, edge: np.ndarray) -> pa.Array:
        """The tokens of each text joined by spaces: the vocabulary names no decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), self.names.take(pa.array(ids))), " ")

    def block(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Number of tokens, ids as bytes and decoded text of many texts."""
        texts = texts.to_pylist()
        if len(texts) == 1 and len(texts[0]) > SPAN:
            return self._long(texts[0])
        ids, edge = self._ids(texts)
        return pa.array(np.diff(edge)), filled(pa.binary(), edge * 4, pa.py_buffer(ids.astype("<u4"))), self.decode(ids, edge)

    def _long(self, text: str) -> tuple[pa.Array, pa.Array, pa.Array]:
        """``block`` of one text, by spans."""
        at, count, held, said = 0, 0, pa.BufferOutputStream(), pa.BufferOutputStream()
        while at < len(text):
            found = SPAN_END.search(text, at + SPAN)
            end = found.end() if found else len(text)
            ids, edge = self._ids([text[at:end]])
            if len(ids):
                held.write(ids.astype("<u4"))
                said.write(b" " if count else b"")
                said.write(self.decode(ids, edge)[0].as_buffer())
            at, count = end, count + len(ids)
        held, said = held.getvalue(), said.getvalue()
        return pa.array([count]), filled(pa.binary(), [0, held.size], held), filled(pa.string(), [0, said.size], said)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian 32-bit), decoded.

    Null and empty texts have no ids and decode to the empty text. Rows are independent, so repeated ones and null
    ids stay as they are; a long text takes memory in proportion to its length; extra columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for block in blocks(batches, limit=2 << 20):
            found = coder.block(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *found], names=["doc_id", "n_tokens", "ids", "decoded"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
