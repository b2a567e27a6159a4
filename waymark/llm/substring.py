"""Passages that occur more than once, found exactly by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. The minimiser of a window is the least hash among its
runs of ``MINI`` words; equal windows have equal minimisers. Consecutive windows that share a
minimiser form a super-k-mer, which travels as one packed string of word hashes to the
minimiser's bucket. Minimisers that occur once in the corpus cannot belong to a repeated window,
so only super-k-mers of repeated minimisers travel. In a bucket, sorting the windows' 128-bit hashes
counts them. A minimiser with over ``hot_rows`` super-k-mers (a passage in a great many documents)
is not gathered in one bucket: its windows are counted by a plain grouping on the window,
which combines before the shuffle. Equal windows of one super-k-mer are one row of that grouping.

Texts that are equal as a whole are one class; only one of each class sends its super-k-mers.

Texts are read in chunks that overlap by a window, and a super-k-mer holds ``MOST`` windows at most, so a worker
needs 8 bytes for each word of a text beside the text itself, and a bucket's bytes are bounded by ``hot_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut
from .words import CHUNK, IS_SPACE, U, Words, mix, pieces, powers, rolling, signed, window_min

WINDOW, MINI, MOST = 35, 8, 64
NO_ID = -(1 << 63)
_PLACE = U(0xFFFF)
_TABLES = [powers(b | 1, CHUNK + 64) for b in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


def super_kmers(words: Words, window: int = WINDOW, mini: int = MINI) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, minimiser, first window, number of windows, new occurrences of the minimiser) of each run of windows
    with one minimiser, chunk by chunk; a window is numbered by the index of its first word.

    Minimisers are compared by their upper 48 bits, then by place, so that one minimum gives both.
    """
    last = -1
    for at in range(0, len(words.hashes) - window + 1, CHUNK):
        h = rolling(words.hashes[at : at + CHUNK + window - 1], mini)
        least = window_min((h & ~_PLACE) | np.arange(len(h), dtype=U), window - mini + 1)
        begin = np.arange(at, at + len(least))
        text = np.searchsorted(words.first, begin, side="right") - 1
        whole = np.flatnonzero(begin + window <= words.first[text + 1])
        if not len(whole):
            continue
        where, text = (least[whole] & _PLACE).astype(np.int64), text[whole]
        value = h[where]
        new = np.ones(len(where), np.int64)
        new[1:] = where[1:] != where[:-1]
        new[0] = where[0] + at != last
        last = int(where[-1]) + at
        first = np.ones(len(where), bool)
        first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        runs = np.flatnonzero(first)
        parts = -(-np.diff(np.append(runs, len(where))) // MOST)
        runs = np.repeat(runs, parts) + MOST * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        yield text[runs], value[runs], begin[whole[runs]], np.diff(np.append(runs, len(where))), np.add.reduceat(new, runs)


def window_hashes(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Two hashes of each window of packed runs: run i has counts[i] windows from word starts[i]."""
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    out = [np.empty(len(at), U) for _ in _TABLES]
    for base in range(0, len(flat), CHUNK):
        here = slice(*np.searchsorted(at, [base, base + CHUNK]))
        part, place = flat[base : base + CHUNK + window - 1], at[here] - base
        for to, (up, down) in zip(out, _TABLES, strict=True):
            sums = np.concatenate([np.zeros(1, U), np.cumsum(part * up[: len(part)], dtype=U)])
            to[here] = mix((sums[place + window] - sums[place]) * down[place])
    return out


def _words(block: pa.RecordBatch) -> Words:
    return Words([t.encode() for t in block.column("text").to_pylist()])


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        words = _words(block)
        texts, values = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        for text, value, _, _, times in super_kmers(words):
            times = np.minimum(times, 2)  # no occurrence, one, or several: then the windows may be equal
            texts.append(np.repeat(text, times))
            values.append(np.repeat(value, times))
        ends = np.searchsorted(np.concatenate(texts), np.arange(len(words.counts) + 1))
        mins = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(np.concatenate(values))))
        yield pa.RecordBatch.from_arrays(
            [block.column("key"), block.column("id"), pa.array(words.counts.astype(np.int64)), mins],
            names=["key", "id", "n_words", "mins"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The super-k-mers of the wanted minimisers of each text, which come sorted."""
    names = ["m", "key", "id", "start", "words"]
    for block in blocks(batches):
        words = _words(block)
        wanted = block.column("wanted")
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(wanted).to_numpy(zero_copy_only=False))])
        m = wanted.flatten().to_numpy()
        for text, value, first, count, _ in super_kmers(words):
            value, found = signed(value), np.zeros(len(text), bool)
            edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                lo, hi = bounds[text[i]], bounds[text[i] + 1]
                found[i:j] = m[lo + np.minimum(np.searchsorted(m[lo:hi], value[i:j]), hi - lo - 1)] == value[i:j]
            kept = np.flatnonzero(found)
            size = count[kept] + WINDOW - 1
            ends = np.cumsum(size)
            flat = words.hashes[np.repeat(first[kept] - (ends - size), size) + np.arange(int(size.sum()))]
            offsets = np.concatenate([[0], 8 * ends]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            own = pa.array(text[kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[kept]), block.column("key").take(own), block.column("id").take(own), pa.array(first[kept] - words.first[text[kept]]), packed], names=names
            )


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row, offset in the row's run, and hashes of every window in a batch of packed runs."""
    packed = batch.column("words")
    sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    flat = np.frombuffer(b"".join(packed.to_pylist()), U)
    counts = sizes - WINDOW + 1
    hashes = window_hashes(flat, np.cumsum(sizes) - sizes, counts)
    row = np.repeat(np.arange(len(packed)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts), hashes


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of words under repeated windows; rows of one minimiser follow each other. Only the
    bucket that a batch ends in is held over to the next batch."""

    def repeated(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, offset, (one, two) = _unpack(batch)
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.sort(order[twice])
        row, offset = row[hit], offset[hit]
        first = np.ones(len(hit), bool)
        first[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(hit)) - 1
        at = pa.array(row[begin])
        start = batch.column("start").to_numpy()[row[begin]]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("key").take(at),
                batch.column("id").take(at),
                pa.array(start + offset[begin]),
                pa.array(start + offset[end] + WINDOW if len(begin) else start),
            ],
            names=["key", "id", "start", "stop"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for some in blocks(iter([batch]), "words"):
            whole = pa.Table.from_batches([*held, some]).combine_chunks().to_batches()[0]
            m = whole.column("m").to_numpy()
            last = int(np.searchsorted(m, m[-1]))
            if last:
                yield repeated(whole.slice(0, last))
            held = [whole.slice(last)]
    if held:
        yield repeated(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different windows of each run, with the words they start at: bits of the 64 words from ``at`` on."""
    for batch in blocks(batches, "words", limit=1 << 19):
        row, offset, (one, two) = _unpack(batch)
        start = batch.column("start").to_numpy()[row] + offset
        at = start & ~63
        order = np.lexsort((two, one, at, row))
        row, at, one, two = row[order], at[order], one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        bits = np.bitwise_or.reduceat(U(1) << (start[order] & 63).astype(U), first) if len(first) else np.zeros(0, U)
        own = pa.array(row[first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(one[first])), pa.array(signed(two[first])), batch.column("key").take(own), batch.column("id").take(own), pa.array(at[first]), pa.array(signed(bits))],
            names=["one", "two", "key", "id", "at", "bits"],
        )


def _edges(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff((~IS_SPACE[part]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def without(data: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, bytes]:
    """(words, removed words, the others joined by spaces) of a text, without the words start[i] to stop[i]."""
    size = 1 << 20
    gone = None
    if len(start):
        n = sum(len(_edges(np.frombuffer(data[a:b], np.uint8))[0]) for a, b in pieces(data, size))
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, start, 1)
        np.add.at(step, stop, -1)
        gone = np.cumsum(step[:-1]) > 0
    out, n = [], 0
    for a, b in pieces(data, size):
        part = np.frombuffer(data[a:b] + b" ", np.uint8).copy()
        begin, end = _edges(part)
        n += len(begin)
        if gone is not None:
            stay = ~gone[n - len(begin) : n]
            begin, end = begin[stay], end[stay]
        mark = np.zeros(len(part) + 1, np.int8)
        mark[begin] += 1
        mark[end + 1] -= 1
        part[end] = 0x20
        out.append(part[np.cumsum(mark[:-1], dtype=np.int8) > 0].tobytes())
    return n, 0 if gone is None else int(gone.sum()), b"".join(out)[:-1]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        lists = block.column("ranges")
        flat, parent = lists.flatten(), pc.list_parent_indices(lists)
        own = pc.and_(pc.equal(flat.field("key"), block.column("key").take(parent)), pc.equal(flat.field("id"), block.column("id").take(parent)))
        flat, parent = flat.filter(own), parent.filter(own).to_numpy()
        start, stop, bits = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "stop", "bits"))
        each = np.flatnonzero(bits)
        nth, bit = np.nonzero(np.unpackbits(bits[each].astype("<i8").view(np.uint8), bitorder="little").reshape(-1, 64))
        single = start[each][nth] + bit
        plain = bits == 0
        start, stop = np.concatenate([start[plain], single]), np.concatenate([stop[plain], single + WINDOW])
        parent = np.concatenate([parent[plain], parent[each][nth]])
        order = np.argsort(parent, kind="stable")
        start, stop = start[order], stop[order]
        cuts = np.searchsorted(parent[order], np.arange(block.num_rows + 1))
        texts = block.column("text").to_pylist()
        done = [without(t.encode(), start[i:j], stop[i:j]) for t, i, j in zip(texts, cuts[:-1], cuts[1:], strict=True)]
        kept = [c for c in block.schema.names if c not in ("key", "handle", "ranges")]
        yield pa.RecordBatch.from_arrays(
            [*(block.column(c) for c in kept), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2].decode() for d in done], pa.string())],
            names=[*kept, "n_words", "n_removed", "kept_text"],
        )


def repeated_ranges(texts: DataFrame, hot_rows: int = 4096) -> DataFrame:
    """(handle, ranges) for texts (key, id, text, handle, ...) that have words under repeated windows.

    A range is words start to stop, or, where bits is not 0, a window from each of the 64 words from start whose
    bit is set. A handle is only a hash of (key, id), so each range says whose it is; were two texts to share a handle,
    each would send a few runs more. ``texts`` is shuffled once, by handle, for all its uses here and by a
    caller that joins it with the result by handle.
    """
    narrow_ = texts.select("key", "id", "text")
    rows = cut(narrow_.mapInArrow(_minimisers, "key binary, id long, n_words long, mins array<long>"))
    long_ = rows.where(f"n_words >= {WINDOW}")
    classes = long_.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("id", "mins")).alias("x"))
    classes = cut(classes.select("key", "copies", "x.*"))

    handle = F.xxhash64("key", "id").alias("handle")
    often = classes.select(F.explode("mins").alias("m")).groupBy("m").count().where("count > 1")
    often = often.select("m", (F.col("count") > hot_rows).alias("hot"))
    found = classes.select(handle, F.explode(F.array_distinct("mins")).alias("m"))
    wanted = cut(found.join(often, "m").groupBy("handle", "hot").agg(F.sort_array(F.collect_list("m")).alias("wanted")))

    def runs(hot: bool) -> DataFrame:
        own = wanted.where(F.col("hot") == hot).drop("hot")
        return texts.join(own, "handle").mapInArrow(_packed, "m long, key binary, id long, start long, words binary")

    by_bucket = runs(False).repartition("m").sortWithinPartitions("m")
    none = F.lit(0).cast("long")
    cold = by_bucket.mapInArrow(_count_buckets, "key binary, id long, start long, stop long").withColumn("bits", none)
    windows = runs(True).mapInArrow(_windows, "one long, two long, key binary, id long, at long, bits long")
    twice = windows.groupBy("one", "two").agg(F.sum(F.bit_count("bits")).alias("n")).where("n > 1").drop("n")
    hot = windows.join(twice, ["one", "two"]).groupBy("key", "id", "at").agg(F.bit_or("bits").alias("bits"))
    copies = (
        long_.select("key", "id", "n_words")
        .join(classes.where("copies > 1").select("key"), "key")
        .select("key", "id", none.alias("start"), F.col("n_words").alias("stop"), none.alias("bits"))
        .distinct()
    )
    every = cold.union(hot.select("key", "id", "at", none, "bits")).union(copies)
    return every.groupBy(handle).agg(F.collect_list(F.struct("key", "id", "start", "stop", "bits")).alias("ranges"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_words, n_removed, kept_text, and the columns ``carry``.

    Every word under a window of 35 words that also starts anywhere else is removed; kept words
    are joined by one space. Null and empty texts and texts of fewer than 35 words lose
    nothing; equal texts of 35 words or more lose everything; a null id stays null, a null text
    becomes empty; texts of any length are handled alike; an empty table gives an empty result.
    """
    base = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *(F.col(f"`{c}`").alias(f"__{c}") for c in carry),
    )
    base = base.withColumn("key", F.unhex(F.md5("text"))).withColumn("handle", F.xxhash64("key", "id"))
    joined = base.join(repeated_ranges(base, hot_rows), "handle", "left")
    kinds = "".join(f", `__{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    kept = joined.mapInArrow(_kept, f"id long, text string{kinds}, n_words long, n_removed long, kept_text string")
    return kept.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "text",
        "n_words",
        "n_removed",
        "kept_text",
        *(F.col(f"`__{c}`").alias(c) for c in carry),
    )
