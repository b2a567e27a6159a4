"""Word, shingle and window hashes of many texts at once, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D. All hashes are 64-bit
polynomials over randomised byte or word values, modulo 2**64, with a final mix.

Everything goes by spans of fixed size, whatever the length of a text, so that beside the words' hashes
(8 bytes each) no table or temporary grows with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes, and words, that are hashed at a time.
SPAN, CHUNK = 1 << 16, 1 << 15
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place on a fresh array."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        values = mix(np.arange(1, 257, dtype=U) * U(_STEP))
    is_space = np.zeros(256, bool)
    is_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    values[is_space] = 0
    return values, is_space


VALUES, IS_SPACE = _byte_values()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


_UP, _DOWN = powers(_BASE, SPAN)
_STEP_UP, _STEP_DOWN = powers(_STEP, CHUNK + 64)


def rolling(hashes: np.ndarray, n: int, up: np.ndarray = _STEP_UP, down: np.ndarray = _STEP_DOWN) -> np.ndarray:
    """Hash of every n consecutive values of at most ``len(up) - 1`` values."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * up[: len(hashes)], dtype=U)])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts with a line end after each, and where each begins (and the last ends)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return b"\n".join(texts) + b"\n", np.concatenate([[0], np.cumsum(sizes)])


def pieces(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that begin and end between words; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            found = BLANK.search(data, end)
            end = found.end() if found else len(data)
        yield at, min(end, len(data))
        at = end


class Words:
    """The words of a list of texts (as UTF-8 bytes), without a Python loop over words.

    first[i]:first[i+1] are the words of text i; hashes: one per word; with ``places`` also starts and
    ends: byte ranges in ``data``.
    """

    def __init__(self, texts: list[bytes], places: bool = False):
        self.data, offsets = joined(texts)
        buf = np.frombuffer(self.data, np.uint8)
        sums: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        first = np.zeros(len(offsets), np.int64)
        opened, begun, n = False, 0, 0
        for at in range(0, len(buf), SPAN):
            part = buf[at : at + SPAN]
            word = ~IS_SPACE[part]
            edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(opened)))
            begin, end = (edge[1::2], edge[0::2]) if opened else (edge[0::2], edge[1::2])
            values = VALUES[part] * _UP[: len(part)]
            if opened and word[0]:  # the rest of a word of the span before
                rest = values[: begin[0] if len(begin) else len(values)].sum(dtype=U, keepdims=True)
                sums[-1][-1:] += rest * U(pow(_BASE, at - begun, 1 << 64))
            here = slice(*np.searchsorted(offsets, [at, at + len(part)]))
            first[here] = n + np.searchsorted(begin, offsets[here] - at)
            if len(begin):
                sums.append(np.add.reduceat(values, begin) * _DOWN[begin])
                begun = at + int(begin[-1])
                n += len(begin)
            if places:
                starts.append(begin + at)
                ends.append(end + at)
            opened = bool(word[-1])
        first[-1] = n
        self.first = first
        self.counts = np.diff(first)
        self.hashes = mix(np.concatenate(sums)) if sums else np.zeros(0, U)
        if places:
            none = np.zeros(0, np.int64)
            self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])

    def chunks(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hash of every run of n consecutive words of one text, and the index of its first word, at
        most CHUNK at a time. Texts of fewer than n words give none."""
        for at in range(0, len(self.hashes) - n + 1, CHUNK):
            out = rolling(self.hashes[at : at + CHUNK + n - 1], n)
            inside = np.ones(len(out), bool)
            lo, hi = np.searchsorted(self.first, [at, at + len(out) + n], side="left")
            for b in self.first[max(1, lo) : min(hi, len(self.first) - 1)].tolist():
                inside[max(0, b - n + 1 - at) : max(0, b - at)] = False
            where = np.flatnonzero(inside)
            yield out[where], where + at

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of ``chunks(n)``, and where those of each text begin (and the last ends)."""
        cuts = np.concatenate([[0], np.cumsum(np.maximum(self.counts - n + 1, 0))])
        out, at = np.empty(cuts[-1], U), 0
        for found, _ in self.chunks(n):
            out[at : at + len(found)] = found
            at += len(found)
        return out, cuts

    def whole(self, most: int) -> np.ndarray:
        """One hash of the whole word sequence of each text of ``most`` words at most; 0 for the others and for
        texts without words."""
        out = np.zeros(len(self.counts), U)
        short = np.flatnonzero((self.counts > 0) & (self.counts <= most))
        for j in range(most):
            some = short[self.counts[short] > j]
            out[some] += self.hashes[self.first[some] + j] * _STEP_UP[j]
        out[short] = mix(out[short] + self.counts[short].astype(U))
        return out


def window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = n - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
