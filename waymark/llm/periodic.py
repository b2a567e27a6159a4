"""Periodic runs of words, by the dictionary of basic factors.

For every length 2**k each place gets a number that stands for the 2**k words from there on (two numbers of half the length make
one). The next occurrence of the same factor of one document lies exactly one period ahead all along a run of that period, if the factor
is as long as the period: the conjugates of a word that is no power differ. So places with equal distances to their successors,
between half the factor's length and all of it, form arithmetic progressions, and each unbroken stretch of them is one run, whose length is
the stretch's plus factor and period. Periods of up to 2**k are all settled at level k, so no run is found twice, and
a run of four periods is long enough to show at its level. Places whose factor occurs once leave the higher levels.

All documents of a block go through together; numbers begin with the document, so that factors of two never agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import blocks, narrow
from .words import U, Words, mix

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Words that are joined at a time.
JOINED = 1 << 15


def find_runs(hashes: np.ndarray, first: np.ndarray, periods: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``periods`` periods and ``least`` words, ordered by start, then period.

    ``hashes``: one per word; words first[d]:first[d+1] are document d.
    """
    if periods < 4:
        raise ValueError("a run shorter than four periods may not show at its level")
    counts = np.diff(first)
    n = len(hashes)
    code = mix(hashes + np.repeat(np.arange(1, len(counts) + 1, dtype=U) * U(0x9E3779B97F4A7C15), counts)).view(np.int64)
    at = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    end = np.repeat(first[1:], counts).astype(at.dtype)
    number = np.empty(n, at.dtype)
    found: list[np.ndarray] = []
    size, longest = 1, int(counts.max(initial=0))
    while len(at) > 1:
        order = np.argsort(code, kind="stable")
        code = code[order]
        same = code[1:] == code[:-1]
        del code
        place = at[order]
        ahead = np.diff(place)
        hit = np.flatnonzero(same & (2 * ahead > size) & (ahead <= size))
        i, q = place[hit].astype(np.int64), ahead[hit].astype(np.int64)
        by = np.argsort(i, kind="stable")
        i, q = i[by], q[by]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(q) != 0), [True]])) if len(i) else np.zeros(1, np.int64)
        begin, stretch = edge[:-1], np.diff(edge)
        length = stretch - 1 + size + q[begin]
        good = length >= np.maximum(least, periods * q[begin])
        found.append(np.stack([i[begin][good], length[good], q[begin][good]]))
        if periods * (size + 1) > longest:
            break
        # Numbers of the factors that occur again, and from them those of twice the length.
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        number[:] = -1
        number[place[again]] = np.cumsum(np.concatenate([[True], ~same]))[again]
        at = np.sort(place[again])
        del order, place, ahead, again, same
        at = at[at + 2 * size <= end[at]]
        second = number[at + size]
        at, second = at[second >= 0], second[second >= 0]
        code = number[at].astype(np.int64) << 32 | second
        size *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    by = np.lexsort([period, start])
    return start[by], length[by], period[by]


def repeated(n: int, start: int, period: int) -> np.ndarray:
    """For each of n words, which one stands there if those from ``start`` on repeat the ``period`` words there."""
    out = np.arange(n)
    out[start:] = start + (out[start:] - start) % period
    return out


def _join(data: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    parts = []
    for k in range(0, len(starts), JOINED):
        parts.append(b" ".join([data[a:b] for a, b in zip(starts[k : k + JOINED].tolist(), ends[k : k + JOINED].tolist(), strict=True)]))
    return b" ".join(parts).decode()


def runs_of(ids: list, texts: list[bytes], repeat: Callable | None = None) -> Iterator[tuple[int, np.ndarray, str]]:
    """Number of words, runs (rows of start, length, period) and text without the repeats of each document."""
    own = Words(texts, places=True)
    hashes, starts, ends, first = own.hashes, own.starts, own.ends, own.first
    if repeat is not None:
        order = None
        for d, doc_id in enumerate(ids):
            n = int(own.counts[d])
            asked = repeat(doc_id, n)
            if asked is not None and n:
                order = np.arange(len(hashes)) if order is None else order
                order[first[d] : first[d + 1]] = first[d] + repeated(n, *asked)
        if order is not None:
            hashes, starts, ends = hashes[order], starts[order], ends[order]
    start, length, period = find_runs(hashes, first)
    # A word goes if a run holds it after that run's first period.
    cover = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    keep = np.cumsum(cover[:-1], dtype=np.int32) == 0
    cut = np.searchsorted(start, first)
    for d in range(len(texts)):
        a, b = int(first[d]), int(first[d + 1])
        mine = slice(int(cut[d]), int(cut[d + 1]))
        kept = keep[a:b]
        yield b - a, np.stack([start[mine] - a, length[mine], period[mine]], axis=1), _join(own.data, starts[a:b][kept], ends[a:b][kept])


def periodic_runs(docs: DataFrame, repeat: Callable[[int | None, int], tuple[int, int] | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    A run is a stretch of at least 6 words and four times its smallest period in words, which no neighbouring word carries on; ``runs``
    are ordered by start, then period, numbered in words from 0. ``collapsed`` is the text without the words that any run holds after
    its first period, one space between words. ``repeat(doc_id, n)`` may say that the words of a text of n words from ``start`` on are first
    overwritten by repeats of the ``period`` words there, as (start, period).

    A null or empty text and one of blanks alone have no words, no runs and an empty collapsed text. Runs that overlap are all
    returned. Null and repeated ids are rows like others; an empty table gives an empty result; other columns are
    ignored. Texts of any length are read whole. No shuffle. Words are compared by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=2 << 20):
            ids = block.column("doc_id")
            texts = pc.cast(block.column("text"), pa.binary()).to_pylist()
            n_words, offsets, all_runs, collapsed = [], [0], [], []
            for n, runs, text in runs_of(ids.to_pylist(), texts, repeat):
                n_words.append(n)
                all_runs.append(runs)
                offsets.append(offsets[-1] + len(runs))
                collapsed.append(text)
            columns = np.concatenate(all_runs).T
            runs = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), lists, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return narrow(docs, id_col, text_col).mapInArrow(run, RUNS)
