"""Near-duplicate documents: banded MinHash candidates, verified by odd sketches and exactly.

1. Texts are lower-cased (A-Z) and cut into words; texts of equal word sequence form one class,
   which its least doc_id stands for.
2. Each class gets ``BANDS * ROWS`` MinHash values of its distinct five-word shingles. The values
   are folded into an odd sketch, a bitmap in which every (position, value) flips one bit: the
   bits of the XOR of two sketches count the values in which the two differ, most precisely
   where similarities are high.
3. Classes that share a band are candidates. First each is held against the bucket's least
   class (a star, so the pairs are no more than the bucket's rows); then, among buckets that
   still hold several components (open buckets), against the members of other components. Candidate
   pairs pass the odd-sketch and size tests and the parity bound below, then are confirmed on full
   shingle sets.
4. Components of the confirmed links.

Members of an open bucket meet in one of two ways, both of which find every link among them. A bucket
of over ``WIDE`` members goes by prefixes if these give at most ``FEW`` pairs a member: shingles are put
into one order, rare ones first, and the larger set of a link shares one of its first quarter with the
first seventh of the smaller set. Texts with a common part and much of their own thus meet
nobody. The others, small or with too many prefix pairs, are compared pair by pair.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**28, about 2e-5; the
sketch test turns away a true pair less often still (over four standard deviations).

Parity bound: a second bitmap folds all shingles of the set. Each bit in which two such bitmaps differ
takes at least one shingle that only one of the sets has, so a pair with more than
(1 - s) / (1 + s) of both sizes differing bits cannot have similarity s. This test loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, narrow
from .components import components
from .words import U, Words, mix, pieces, signed

BANDS, ROWS = 28, 4
SHINGLE, PERCENT = 5, 75
SKETCH_BITS = 256
#: Most differing bits at which a pair is still held to be a candidate: at similarity 0.75 the mean
#: is 45 and the standard deviation about 9.
MOST_BITS = 84
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=U) * U(2) + U(1)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=U)

PARITY_BITS = 1024
#: Shingles that are hashed at a time.
PART = 1 << 18
_KS = [f"k{j}" for j in range(SKETCH_BITS // 64)]
_FS = [f"f{j}" for j in range(PARITY_BITS // 64)]
_SKINNY = ["n", *_KS, *_FS]
#: Most ids of candidate documents that are broadcast to pick their texts (8 bytes each).
BROADCAST_IDS = 500_000

#: Members up to which an open bucket is always compared pair by pair, and prefix pairs for each member up to
#: which a larger one goes by prefixes.
WIDE, FEW = 256, 64
#: Bins in which shingles are counted to put rare ones first; the counts are broadcast (8 bytes each).
ORDER_BINS = 1 << 18

SIGNATURES = "doc_id long, digest binary, n long, bands array<long>, " + ", ".join(f"{c} long" for c in [*_KS, *_FS])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's five-word shingles. A text of one to four words has
    its whole word sequence as one; a text without words has none."""
    words = Words([t.lower() for t in texts])
    hashes, cuts = words.runs(SHINGLE)
    whole, counts = words.whole(SHINGLE - 1), words.counts.tolist()
    del words
    out = []
    for i, count in enumerate(counts):
        if count >= SHINGLE:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        else:
            out.append(whole[i : i + 1] if count else whole[:0])
    return out


def digest(text: bytes) -> bytes:
    """Of the word sequence of a text in lower case."""
    h = xxhash.xxh3_128()
    for a, b in pieces(text, 1 << 20):
        if words := text[a:b].lower().split():
            h.update(b" ".join(words) + b" ")
    return h.digest()


def in_parts(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which sets, where each begins, values) of parts of about PART values; a larger set is cut, and each part
    has a set once at most."""
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= PART):
            n += len(sets[j])
            j += 1
        if n <= PART:
            some = [k for k in range(i, j) if len(sets[k])]
            if some:
                yield np.array(some), np.cumsum([0, *(len(sets[k]) for k in some[:-1])]), np.concatenate([sets[k] for k in some])
        else:
            for at in range(0, n, PART):
                yield np.array([i]), np.zeros(1, np.int64), sets[i][at : at + PART]
        i = j


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(BANDS * ROWS, number of sets) MinHash values; no set may be empty."""
    out = np.full((BANDS * ROWS, len(sets)), U(0xFFFFFFFFFFFFFFFF))
    for which, begin, values in in_parts(sets):
        for k, (m, f) in enumerate(zip(_MULTIPLY, _FLIP, strict=True)):
            out[k, which] = np.minimum(out[k, which], np.minimum.reduceat((values ^ f) * m, begin))
    return out


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """(number of sets, SKETCH_BITS / 64) parity bitmaps of MinHash values."""
    n = values.shape[1]
    bits = np.zeros((n, SKETCH_BITS), np.uint8)
    rows = np.arange(n)
    for k, v in enumerate(values):
        bits[rows, (mix(v + U(k)) % U(SKETCH_BITS)).astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1).view(np.int64)


def parity_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """(number of sets, PARITY_BITS / 64) parity bitmaps of whole sets."""
    odd = np.zeros((len(sets), PARITY_BITS), bool)
    for which, begin, values in in_parts(sets):
        row = np.repeat(np.arange(len(which)), np.diff(np.append(begin, len(values))))
        at = row * PARITY_BITS + (mix(values + U(PARITY_BITS)) % U(PARITY_BITS)).astype(np.int64)
        odd[which] ^= (np.bincount(at, minlength=len(which) * PARITY_BITS) & 1).astype(bool).reshape(len(which), -1)
    return np.packbits(odd, axis=1).view(np.int64)


def band_keys(values: np.ndarray) -> np.ndarray:
    """(number of sets, BANDS) keys."""
    keys = []
    for b in range(BANDS):
        key = np.full(values.shape[1], b + 1, U)
        for v in values[b * ROWS : (b + 1) * ROWS]:
            key = mix(key * U(0x9E3779B97F4A7C15) + v)
        keys.append(signed(key))
    return np.stack(keys, axis=1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        texts = [t.encode() for t in block.column("text").to_pylist()]
        sets = shingle_sets(texts)
        some = np.flatnonzero([len(s) for s in sets])
        sketches = np.zeros((len(texts), len(_KS) + len(_FS)), np.int64)
        bands: list = [[]] * len(texts)
        if len(some):
            values = min_hashes([sets[i] for i in some])
            sketches[some] = np.concatenate([odd_sketches(values), parity_bitmaps([sets[i] for i in some])], axis=1)
            for i, keys in zip(some, band_keys(values), strict=True):
                bands[i] = keys
        digests = [digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                block.column("doc_id"),
                pa.array(digests, pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                *(pa.array(np.ascontiguousarray(sketches[:, j])) for j in range(sketches.shape[1])),
            ],
            names=["doc_id", "digest", "n", "bands", *_KS, *_FS],
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in blocks(batches, "text_a", limit=1 << 20):
        for block in blocks(iter([whole]), "text_b", limit=2 << 20):
            left, where = np.unique(block.column("a").to_numpy(), return_inverse=True)
            first = {int(w): i for i, w in reversed(list(enumerate(where)))}
            ones = shingle_sets([block.column("text_a")[first[k]].as_py().encode() for k in range(len(left))])
            others = shingle_sets([t.encode() for t in block.column("text_b").to_pylist()])
            keep = []
            for w, other in zip(where, others, strict=True):
                one = ones[w]
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(common > 0 and 100 * common >= PERCENT * (len(one) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield block.select(["a", "b"]).filter(mask)


def _side(df: DataFrame, side: str, *more) -> DataFrame:
    return df.select(F.col("doc_id").alias(side), *more, *(F.col(c).alias(f"{c}_{side}") for c in _SKINNY))


def _differing(names: list[str]):
    counts = [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in names]
    return sum(counts[1:], counts[0])


def _likely():
    """Sizes that allow the similarity, an odd-sketch distance that does not rule it out, and the
    parity bound."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    bound = _differing(_FS) * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)
    return sizes & (_differing(_KS) <= MOST_BITS) & bound


def _picked(texts: DataFrame, ids: DataFrame, shuffled: bool = True) -> DataFrame:
    """The texts of ``ids`` (doc_id). If these are few, they are broadcast; if not, and the caller joins
    the texts by id itself, all texts are returned."""
    if ids.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return texts.join(ids, "doc_id", "left_semi") if shuffled else texts


def _confirmed(likely: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among likely pairs (a, b), by their full shingle sets."""
    texts = _picked(texts, likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), shuffled=False)
    with_a = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(with_b.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"))


def _bin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ORDER_BINS, np.int64)
    for block in blocks(batches):
        values = np.concatenate(shingle_sets([t.encode() for t in block.column("text").to_pylist()]))
        total += np.bincount((values % U(ORDER_BINS)).astype(np.int64), minlength=ORDER_BINS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bin", "n"])


def prefixes(texts: DataFrame) -> DataFrame:
    """(doc_id, n, h, small) of the shingles h that a text of n shingles may have to share with another one.

    Shingles are ordered by how many sets have one in the same of ``ORDER_BINS`` bins, then by hash; any order
    that all texts have in common is right. The least common shingle of a link is at most n - c
    places from the front in either set, c being the least size of the intersection: three quarters of the larger set, and
    six sevenths of the smaller one, whose places are marked ``small``. Shingles that only one text has are left out.
    """
    order = np.zeros(ORDER_BINS, np.int64)
    counted = texts.mapInArrow(_bin_counts, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    order[counted["bin"].to_numpy()] = counted["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = shingle_sets([t.encode() for t in block.column("text").to_pylist()])
            hashes, smalls = [], []
            for s in sets:
                n = len(s)
                often = order[(s % U(ORDER_BINS)).astype(np.int64)]
                ranked = np.lexsort((s, often))[: n + 1 - -(-PERCENT * n // 100)]
                small = np.arange(len(ranked)) <= n - -(-2 * PERCENT * n // (100 + PERCENT))
                met = often[ranked] > 1
                hashes.append(signed(s[ranked[met]]))
                smalls.append(small[met])
            rows = np.repeat(np.arange(len(sets)), [len(h) for h in hashes])
            sizes = np.array([len(s) for s in sets])[rows]
            columns = [block.column("doc_id").take(pa.array(rows)), pa.array(sizes), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(smalls))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h", "small"])

    return texts.mapInArrow(run, "doc_id long, n long, h long, small boolean")


def prefix_pairs(wide: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bands, pairs): the bands of ``wide`` (band, doc_id, part), open buckets of many members, that prefixes
    give few pairs for, and the pairs (a, b) of different parts among their members, every link included."""
    found = cut(prefixes(_picked(texts, wide.select("doc_id").distinct())))
    shared = found.groupBy("h").agg((F.count("*") - 1).alias("others"), F.max("small").alias("some")).where("others > 0 and some")
    met = cut(found.join(shared.drop("some"), "h"))
    cost = met.where("small").groupBy("doc_id").agg(F.sum("others").alias("cost"))
    by_band = wide.join(cost, "doc_id", "left").groupBy("band").agg(F.sum("cost").alias("cost"), F.count("*").alias("size"))
    bands = cut(by_band.where(F.coalesce("cost", F.lit(0)) <= F.col("size") * FEW).select("band"))
    parts = wide.join(bands, "band").select("doc_id", "part").distinct()
    entries = met.join(parts, "doc_id")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("h", F.col("doc_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "part")))

    fits = (F.col("n_x") <= F.col("n_y")) & (F.col("n_x") * 100 >= F.col("n_y") * PERCENT) & (F.col("part_x") != F.col("part_y"))
    pairs = side(entries.where("small"), "x").join(side(entries, "y"), "h").where(fits)
    return bands, pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts without words, have no shingles and stand alone. A row with
    a null id is never linked: its component_id is null and it is kept. Rows that repeat an id
    belong to that id's component. Equal texts always share a component; extra columns are
    ignored; an empty table gives an empty result.
    """
    texts = narrow(docs, id_col, text_col)
    rows = cut(texts.mapInArrow(_signatures, SIGNATURES))
    named = rows.where("n > 0 and doc_id is not null")
    least = named.groupBy("digest").agg(F.min(F.struct("doc_id", "bands", *_SKINNY)).alias("x"))
    classes = cut(least.select("digest", "x.*"))

    entries = classes.select(F.explode("bands").alias("band"), "doc_id")
    shared = entries.groupBy("band").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = cut(entries.join(shared, "band"))
    star = members.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    likely = cut(star.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b").where(_likely()).select("a", "b"))
    links = _confirmed(likely, texts)
    found = cut(components(links))

    placed = members.join(found, members.doc_id == found.id, "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    mixed = placed.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size"))
    open_ = cut(placed.join(mixed.where("lo <> hi and size > 2").select("band", "size"), "band"))
    wide = open_.where(F.col("size") > WIDE).drop("size")
    across = None
    if not wide.isEmpty():
        bands, pairs = prefix_pairs(wide, texts)
        across = pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b").where(_likely()).select("a", "b")
        open_ = open_.join(bands, "band", "left_anti")
    full = open_.drop("size").join(classes.select("doc_id", *_SKINNY), "doc_id")
    one, other = _side(full, "a", "band", F.col("part").alias("part_a")), _side(full, "b", "band", F.col("part").alias("part_b"))
    by_pairs = one.join(other, "band").where((F.col("part_a") < F.col("part_b")) & _likely()).select("a", "b")
    across = cut((across.union(by_pairs) if across is not None else by_pairs).distinct())
    if not across.isEmpty():
        more = _confirmed(across, texts)
        if not more.isEmpty():
            found = cut(components(links.union(more)))

    ids = classes.select("digest", F.col("doc_id").alias("rep"))
    return (
        rows.select("doc_id", "digest", "n")
        .join(ids, "digest", "left")
        .join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
            .otherwise(F.coalesce("component", F.when(F.col("n") > 0, F.col("rep")), "doc_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
