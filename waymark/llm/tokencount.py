"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a word lie in a linked list. The pair of neighbours of least rank is taken from the heap again and
again and merged, leftmost first; the count is the number of symbols less the number of merges, so no ids are
written. The heap holds rank and place of each pair; that of a long word holds ranks alone, and each rank the places that wait
for it (4 bytes each): since a merge makes only pairs of higher rank (tested when the vocabulary is read), all
places of a rank are known when it is taken.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import SPACE, byte_symbols
from .common import blocks, narrow
from .packing import UNSAFE

#: Fixed value of the vocabulary: the pattern of its words.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE[1:-1]}\p{{L}}\p{{N}}]+|{SPACE}+(?=$|{SPACE})|{SPACE}+"
#: Words and pieces that a worker remembers at most, and the longest of them; places that are put in order at a time.
WORDS_KEPT, PIECES_KEPT, LONGEST, MANY = 600_000, 400_000, 64, 1 << 12
COUNTS = "doc_id long, n_bytes long, n_tokens long"


class Merger:
    """Counts of single words (bytes) under a byte-level vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.rank: dict[int, int] = {}
        self.left, self.right, self.whole = [], [], []
        made = dict.fromkeys(self.first.tolist(), -1)
        #: Whether any token holds these two bytes side by side; where none does, no merge can join them.
        self.meet = np.zeros((256, 256), bool)
        for n, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if left not in made or right not in made or made.setdefault(whole, n) != n:
                raise ValueError("a merge must come after those that make its parts, and make a new token")
            self.rank[left << 32 | right] = n
            self.left.append(left)
            self.right.append(right)
            self.whole.append(whole)
            self.meet[byte_of[a[-1]], byte_of[b[0]]] = True
        ids = self.first.tolist()
        #: Rank of each pair of bytes, -1 if they do not merge.
        self.begin = [self.rank.get(a << 32 | b, -1) for a in ids for b in ids]
        self.ids = ids

    def count(self, word: bytes) -> int:
        if len(word) <= LONGEST:
            return self._short(word)
        own = np.frombuffer(word, np.uint8)
        cuts = (np.flatnonzero(~self.meet[own[:-1], own[1:]]) + 1).tolist()
        total, at = 0, 0
        for end in (*cuts, len(word)):
            total += self._merged(word[at:end])
            at = end
        return total

    def _short(self, word: bytes) -> int:
        n, begin = len(word), self.begin
        heap = [x for i in range(n - 1) if (x := begin[word[i] << 8 | word[i + 1]] << 8 | i) >= 0]
        if not heap:
            return n
        heapify(heap)
        own, left, right, whole, rank = self.ids, self.left, self.right, self.whole, self.rank.get
        ids = [own[b] for b in word]
        ids.append(-1)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n)), 0
        while heap:
            x = heappop(heap)
            r, i = x >> 8, x & 255
            j = after[i]
            if ids[i] != left[r] or ids[j] != right[r]:
                continue  # one of the two has been merged since
            merges += 1
            k, p, made = after[j], before[i], whole[r]
            ids[i], ids[j], after[i], before[k] = made, -1, k, i
            if p >= 0 and (new := rank(ids[p] << 32 | made)) is not None:
                heappush(heap, new << 8 | p)
            if k < n and (new := rank(made << 32 | ids[k])) is not None:
                heappush(heap, new << 8 | i)
        return n - merges

    def _merged(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        ids = array("i", self.first[np.frombuffer(word, np.uint8)].tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        rank, waiting = self.rank.get, {}
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                if r in waiting:
                    waiting[r].append(i)
                else:
                    waiting[r] = array("i", (i,))
        heap = list(waiting)
        heapify(heap)
        left_of, merges = self.left, 0
        while heap:
            r = heappop(heap)
            left, right, whole = left_of[r], self.right[r], self.whole[r]
            for i in _in_order(waiting.pop(r)):
                j = after[i]
                if ids[i] != left or j == n or ids[j] != right:
                    continue  # one of the two has been merged since
                merges += 1
                k, p = after[j], before[i]
                ids[i], ids[j], after[i] = whole, -1, k
                for at, a, b in ((p, ids[p] if p >= 0 else -1, whole), (i, whole, ids[k] if k < n else -1)):
                    if a >= 0 and b >= 0:
                        new = rank(a << 32 | b)
                        if new is not None:
                            if new in waiting:
                                waiting[new].append(at)
                            else:
                                waiting[new] = array("i", (at,))
                                heappush(heap, new)
                if k < n:
                    before[k] = i
        return n - merges


def _in_order(places: array) -> Iterator[int]:
    """Places from left to right, in slices."""
    if len(places) <= MANY:
        yield from sorted(places)
        return
    own = np.sort(np.frombuffer(places, np.int32))
    for at in range(0, len(own), MANY):
        yield from own[at : at + MANY].tolist()


class Counter:
    """Token counts of texts. Words and pieces that come again are remembered, a bounded number of them."""

    def __init__(self, merger: Merger, special: list[str]):
        self.merger = merger
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pattern = regex.compile(WORDS)
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.merger.count(word.encode())
            if len(word) <= LONGEST:
                if len(self.words) >= WORDS_KEPT:
                    self.words.clear()
                self.words[word] = found
        return found

    def piece(self, piece: str) -> int:
        """Tokens of a text without special strings."""
        if len(piece) > LONGEST:
            return sum(self.word(m.group()) for m in self.pattern.finditer(piece))
        found = self.words.get(piece)
        if found is None:
            found = self.parts.get(piece)
        if found is None:
            words = self.pattern.findall(piece)
            found = sum(map(self.word, words))
            if len(words) > 1:
                if len(self.parts) >= PIECES_KEPT:
                    self.parts.clear()
                self.parts[piece] = found
        return found

    def text(self, text: str) -> int:
        """Tokens of any text; a special string is one token."""
        total, at = 0, 0
        for m in self.special.finditer(text) if self.special else ():
            total += 1 + self.piece(text[at : m.start()])
            at = m.end()
        return total + self.piece(text[at:] if at else text)

    def block(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. The pattern never joins a space to what stands before it, so texts in which no white space
        stands before a space are cut there, and each different piece of a block is counted once."""
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(unsafe).tolist():
            out[i] = self.text(texts[i].as_py())
        safe = np.flatnonzero(~unsafe)
        if len(safe):
            pieces = pc.split_pattern(pc.replace_substring(texts.take(pa.array(safe)), " ", "\x01 "), "\x01")
            coded = pieces.flatten().dictionary_encode()
            tokens = np.fromiter((self.piece(p) for p in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            sums = np.concatenate([[0], np.cumsum(tokens[coded.indices.to_numpy()])])
            offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
            out[safe] = np.diff(sums[offsets])
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a tokenizer file. The file's special strings count as it says: each is one token wherever it stands."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, before = data["model"], data["pre_tokenizer"]
    plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and not before["add_prefix_space"] and data["normalizer"] is None
    added = data["added_tokens"]
    if not plain or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("not a plain byte-level vocabulary")
    merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    if any(t["content"] != "<|endoftext|>" for t in added):
        raise ValueError("unknown special strings")
    return Counter(Merger(model["vocab"], merges), [t["content"] for t in added])


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``; ``vocabulary`` is the path of a tokenizer file.

    A null or empty text has no bytes and no tokens; null and repeated ids are rows like others; an empty table gives an
    empty result; other columns are ignored. A text of any length is counted whole: its words come one after another,
    and a long word takes some 20 times its bytes unless no token crosses some place in it. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for block in blocks(batches, limit=4 << 20):
            text = block.column("text")
            n_bytes = pc.cast(pc.binary_length(text), pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), n_bytes, pa.array(own.block(text))], names=["doc_id", "n_bytes", "n_tokens"])

    return narrow(docs, id_col, text_col).mapInArrow(run, COUNTS)
