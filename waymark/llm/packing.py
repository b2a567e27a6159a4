"""Packing token sequences into fixed windows by best-fit decreasing.

``token_pieces`` turns texts into token pieces (full windows first, then one remainder),
``pack`` lays the pieces into windows. Only the lengths are shuffled: groups drawn by a hash of the piece are
packed apart from each other, each with at most a few windows that are not full. A group comes sorted, longest
pieces first, and is laid as it comes: a task holds only the free room of the group's open windows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import blocks, narrow, share

#: Fixed values of the byte-level vocabulary: its end-of-text string and that string's id.
EOT, EOT_ID = "<|endoftext|>", 50256
#: Tasks that the groups of a table are dealt to at most; a task lays one group after another.
TASKS = 8_192
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: White space before a space: such texts are encoded whole, others by their distinct words.
UNSAFE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] |\\x{01}|<\\|endoftext\\|>"


@lru_cache(maxsize=2)
def byte_bpe(ranks_path: str, pattern: str):
    """The encoder, and the byte length of each id."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={EOT: EOT_ID})
    sizes = np.zeros(max(EOT_ID, *ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    sizes[EOT_ID] = len(EOT)
    return enc, sizes


def encode_block(text: pa.Array, enc, sizes: np.ndarray) -> list[np.ndarray]:
    """Ids of each text. The pattern never joins a space to what stands before it, so words
    with their leading space can be encoded once for a whole block, however often they occur."""
    unsafe = pc.match_substring_regex(text, UNSAFE).to_numpy(zero_copy_only=False)
    out: list = [None] * len(text)
    for i in np.flatnonzero(unsafe):
        out[i] = np.array(enc.encode(text[int(i)].as_py(), allowed_special="all"), np.uint32)
    safe = np.flatnonzero(~unsafe)
    if not len(safe):
        return out
    parts = pc.split_pattern(pc.replace_substring(text.take(pa.array(safe)), " ", "\x01 "), "\x01")
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary
    ids, cuts = _encode_words(words, enc, sizes)
    code = coded.indices.to_numpy(zero_copy_only=False)
    count = np.diff(cuts)[code]
    ends = np.cumsum(count)
    begin = ends - count
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(begin - cuts[code], count)
    flat = ids[at]
    bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    for k, i in enumerate(safe):
        out[i] = flat[bounds[k] : bounds[k + 1]]
    return out


def _encode_words(words: pa.Array, enc, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all distinct words after one another, and where each word's ids begin."""
    first = pc.starts_with(words, " ").to_numpy(zero_copy_only=False)
    listed = words.to_pylist()
    spaced = [w for w, s in zip(listed, first, strict=True) if s]
    ids_spaced = np.array(enc.encode_ordinary("".join(spaced)), np.int64)
    length = np.cumsum(np.fromiter((len(w.encode()) for w in spaced), np.int64, len(spaced)))
    ends = np.searchsorted(np.cumsum(sizes[ids_spaced]), length) + 1
    count = np.zeros(len(listed), np.int64)
    count[first] = np.diff(ends, prepend=0)
    rest = [enc.encode_ordinary(w) for w, s in zip(listed, first, strict=True) if not s]
    count[~first] = [len(r) for r in rest]
    cuts = np.concatenate([[0], np.cumsum(count)])
    ids = np.zeros(cuts[-1], np.uint32)
    is_spaced = np.repeat(first, count)
    ids[is_spaced] = ids_spaced
    ids[~is_spaced] = np.fromiter((x for r in rest for x in r), np.uint32, int((~is_spaced).sum()))
    return ids, cuts


def token_pieces(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    window: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian 32-bit).

    Each text's ids are followed by ``end_id`` and cut into full windows and one remainder. A
    null or empty text has the one id ``end_id``. Repeated rows are separate documents. Other
    columns of ``docs`` are ignored.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = byte_bpe(ranks_path, pattern)
        for block in blocks(batches, limit=2 << 20):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(block.column("doc_id").to_pylist(), encode_block(block.column("text"), enc, sizes), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for to, value in zip(rows, (doc_id, start, len(piece), len(ids), piece.tobytes()), strict=True):
                        to.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, types, strict=True)],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return narrow(docs, id_col, text_col).mapInArrow(pieces, PIECES)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over 0..window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self.stacks[capacity].append(sequence)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the least capacity that is at least ``least``."""
        node = least + self.size
        count = self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.stacks[capacity].pop()


class Packer:
    """Best-fit decreasing of pieces that come longest first."""

    def __init__(self, window: int):
        self.window, self.used, self.open = window, 0, OpenWindows(window)

    def lay(self, lengths: list[int]) -> tuple[list[int], list[int]]:
        """Sequence number and offset of each piece."""
        sequence, offset = [], []
        for size in lengths:
            found = None if size == self.window else self.open.take(size)
            if found is None:
                found = (self.window, self.used)
                self.used += 1
            room, at = found
            sequence.append(at)
            offset.append(self.window - room)
            if room > size:
                self.open.put(room - size, at)
        return sequence, offset


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in any order."""
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((2, len(lengths)), np.int64)
    out[:, order] = Packer(window).lay(lengths[order].tolist())
    return out[0], out[1]


def pack(pieces: DataFrame, n_rows: int, window: int = 1024, group_rows: int = 40_000) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``window`` tokens.

    ``n_rows``: about how many rows there are; it sets the number of groups, drawn by a hash of all columns, each of about
    ``group_rows`` rows, and so the number of windows that may stay partly empty (a few per
    group). Needs the columns doc_id, start, length; carries the others along. Null ids and repeated rows are
    pieces like others; an empty table gives an empty result.
    """
    groups = share(n_rows, group_rows)
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = schema.names

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            of, lengths = batch.column("__group").to_numpy(), batch.column("length").to_numpy()
            edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else np.zeros(1, np.int64)
            sequence, offset = [], []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if of[i] != group:
                    group, packer = of[i], Packer(window)
                at, where = packer.lay(lengths[i:j].tolist())
                sequence += [(int(group) << 32) + x for x in at]
                offset += where
            own = [batch.column(n) for n in names[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    group = F.pmod(F.xxhash64(*(f"`{c}`" for c in pieces.columns)), F.lit(groups))
    dealt = pieces.withColumn("__group", group).repartition(min(groups, TASKS), "__group")
    return dealt.sortWithinPartitions("__group", F.desc("length"), "doc_id", "start").mapInArrow(lay, schema)
