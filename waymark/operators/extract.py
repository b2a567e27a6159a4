"""Coordinates in page text: per page, across page breaks, and as rows and detections.

Pages are (file_id, page_num, text); files are (file_id, file_seq, name, error, intensity, hidden, ...).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import tokens as tk
from ..sources.shared import written
from .pagetext import rects_for_range

TOKEN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("raw", T.StringType()),
        T.StructField("deg", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("sec", T.DoubleType()),
        T.StructField("hemi", T.StringType()),
        T.StructField("negative", T.BooleanType()),
        T.StructField("dd", T.DoubleType()),
        T.StructField("axis", T.StringType()),
        T.StructField("is_dms", T.BooleanType()),
        T.StructField("strength", T.StringType()),
        T.StructField("deg_mark", T.BooleanType()),
        T.StructField("min_mark", T.BooleanType()),
        T.StructField("sec_mark", T.BooleanType()),
    ]
)
_KEYS = [T.StructField("file_id", T.StringType()), T.StructField("page_num", T.IntegerType())]
TOKENS = T.StructType([*_KEYS, T.StructField("token_idx", T.IntegerType()), T.StructField("token", TOKEN)])
PAIRS = T.StructType([*_KEYS, T.StructField("pair_idx", T.IntegerType()), T.StructField("lat", TOKEN), T.StructField("lon", TOKEN)])


def effective_intensity(level: int | None = tk.DEFAULT_LEVEL) -> Column:
    """A file's own level, else the general one."""
    return F.coalesce(F.col("intensity"), F.lit(level))


def with_level(pages: DataFrame, files: DataFrame | None, level: int) -> DataFrame:
    """(file_id, page_num, text, level) of pages that have a digit; pages with a level of their own keep it."""
    if "level" in pages.columns:
        return pages.where(F.regexp_like("text", F.lit("[0-9]"))).select("file_id", F.col("page_num").cast("int"), "text", "level")
    some = pages.where(F.regexp_like("text", F.lit("[0-9]"))).select("file_id", F.col("page_num").cast("int"), "text")
    if files is None:
        return some.withColumn("level", F.lit(level))
    levels = files.select("file_id", effective_intensity(level).alias("level"))
    return some.join(levels, "file_id", "left").withColumn("level", F.coalesce("level", F.lit(level)))


_ARROW_TOKEN = to_arrow_type(TOKEN)
_NO_TOKEN = (None,) * len(TOKEN.fields)


def _token_array(tokens: list[tk.Token | None]) -> pa.Array:
    columns = zip(*(t or _NO_TOKEN for t in tokens), strict=True) if tokens else [()] * len(_NO_TOKEN)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _ARROW_TOKEN, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=list(_ARROW_TOKEN), mask=pa.array([t is None for t in tokens], pa.bool_()))


def _batch(keys: list[tuple], halves_: list[list[tk.Token | None]], schema: T.StructType) -> pa.RecordBatch:
    """A batch of (file_id, page_num, index) and columns of tokens."""
    columns = [pa.array([k[i] for k in keys], to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields[:3])]
    return pa.RecordBatch.from_arrays([*columns, *map(_token_array, halves_)], names=schema.names)


def _different(batch: pa.RecordBatch, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the batch's different values of ``columns`` each row has, and the first row that has each of them."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        own = batch.column(c).dictionary_encode()
        n = len(own.dictionary)
        _, code = np.unique(code * (n + 1) + own.indices.fill_null(n).to_numpy(zero_copy_only=False), return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def read_once(batch: pa.RecordBatch, columns: tuple[str, ...], n_halves: int, rows_of) -> tuple[np.ndarray, pa.Array, list[pa.Array]]:
    """(row of the batch, index, columns of tokens) of all that ``rows_of`` finds in the values of ``columns``: tuples of tokens, and
    of an index unless it is their place. Rows of a batch with equal values are read once."""
    code, first = _different(batch, columns)
    some = batch.select(list(columns)).take(pa.array(first))
    found = [rows_of(*values) for values in zip(*(c.to_pylist() for c in some.columns), strict=True)]
    tokens = [_token_array([x[h] for rows in found for x in rows]) for h in range(n_halves)]
    index = np.array([x[n_halves] if len(x) > n_halves else i for rows in found for i, x in enumerate(rows)], np.int32)
    sizes = np.array([len(rows) for rows in found], np.int64)
    n = sizes[code]
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat((np.cumsum(sizes) - sizes)[code] - (np.cumsum(n) - n), n) + np.arange(len(row))
    return row, pa.array(index[at], pa.int32()), [t.take(pa.array(at)) for t in tokens]


def _per_page(pages: DataFrame, schema: T.StructType, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, tokens = read_once(batch, ("text", "level"), len(schema.fields) - 3, rows_of)
            keys = batch.select(["file_id", "page_num"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*keys.columns, index, *tokens], names=schema.names)

    return pages.mapInArrow(run, schema)


def find_tokens(pages: DataFrame, files: DataFrame | None = None, level: int = tk.DEFAULT_LEVEL) -> DataFrame:
    """(file_id, page_num, token_idx, token) of every token of every page."""
    return _per_page(with_level(pages, files, level), TOKENS, lambda text, n: [(t,) for t in tk.find_tokens(text, n)])


def pair_tokens(tokens: DataFrame, pages: DataFrame, files: DataFrame | None = None, level: int = tk.DEFAULT_LEVEL) -> DataFrame:
    """(file_id, page_num, pair_idx, lat, lon) from tokens (file_id, page_num, token_idx, token) and their pages."""
    found = tokens.groupBy("file_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("token_idx", "token"))).alias("tokens"))
    both = with_level(pages, files, level).join(found, ["file_id", "page_num"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lats, lons = [], [], []
            for f, p, text, n, items in zip(*(batch.column(c).to_pylist() for c in ("file_id", "page_num", "text", "level", "tokens")), strict=True):
                own = [tk.Token(**x["token"]) for x in items]
                for i, (lat, lon) in enumerate(tk.pair_tokens(own, text, n)):
                    keys.append((f, p, i))
                    lats.append(lat)
                    lons.append(lon)
            yield _batch(keys, [lats, lons], PAIRS)

    return both.mapInArrow(run, PAIRS)


def extract_coordinates(pages: DataFrame, files: DataFrame | None = None, level: int = tk.DEFAULT_LEVEL) -> DataFrame:
    """(file_id, page_num, pair_idx, lat, lon) of every page; one half may be null. No shuffle."""
    return _per_page(with_level(pages, files, level), PAIRS, tk.extract)


_AT_LEVELS = T.StructType([*_KEYS, T.StructField("level", T.IntegerType()), *PAIRS.fields[2:]])


def extract_at_levels(pages: DataFrame, levels: tuple[int, ...] = tuple(tk.LEVELS)) -> DataFrame:
    """(file_id, page_num, level, pair_idx, lat, lon) of every page at each of the levels, from one pass over the texts. No shuffle."""
    levels, base = list(levels), tk.LOOSEST + 1

    def rows_of(text: str) -> list[tuple]:
        return [(lat, lon, i * base + n) for n, pairs in zip(levels, tk.extract_at_levels(text, levels), strict=True) for i, (lat, lon) in enumerate(pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, tokens = read_once(batch, ("text",), 2, rows_of)
            keys = batch.select(["file_id", "page_num"]).take(pa.array(row))
            place, level = np.divmod(code.to_numpy(), base)
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(level, pa.int32()), pa.array(place, pa.int32()), *tokens], names=_AT_LEVELS.names)

    some = pages.where(F.regexp_like("text", F.lit("[0-9]")))
    return some.select("file_id", F.col("page_num").cast("int").alias("page_num"), "text").mapInArrow(run, _AT_LEVELS)


def _segments(half: str) -> Column:
    """Page-local ranges of a token of the joint text: before and after the break."""
    start, end = F.col(f"{half}.start"), F.col(f"{half}.end")
    before = F.struct(F.col("prev_page").alias("page_num"), (F.col("tail_start") + start).alias("start"), (F.col("tail_start") + F.least(end, "edge")).alias("end"))
    after = F.struct(F.col("page_num"), F.greatest(F.lit(0), start - F.col("edge") - 1).alias("start"), (end - F.col("edge") - 1).alias("end"))
    both = F.array(F.when(start < F.col("edge"), before), F.when(end > F.col("edge") + 1, after))
    return F.filter(both, lambda x: x.isNotNull())


#: Page numbers of a block; a file of more pages is dealt over several.
BLOCK_PAGES = 4_096


#: What the end of a page is told by: it has a digit; it may follow or precede a number beyond the break; between its number
#: nearest to the break and the break stand no words but those of coordinates.
DIGIT, NEXT_TO_NUMBER, BARE = 1, 2, 4
_BITS = ["head_bits", "tail_bits"]


def _bits(end: str) -> Column:
    """What the end of a page (its "head" or "tail") is like."""
    outer = r"(?s)[0-9].*" if end == "head" else r"(?s)^.*[0-9]"
    words = F.regexp_replace(F.regexp_replace(end, outer, ""), tk.BETWEEN_NUMBERS, "")
    seen = (
        (F.regexp_like(end, F.lit("[0-9]")), DIGIT),
        (F.regexp_like(end, F.lit(tk.BEGINS_AFTER_NUMBER if end == "head" else tk.ENDS_BEFORE_NUMBER)), NEXT_TO_NUMBER),
        (~F.regexp_like(words, F.lit("[A-Za-z]")), BARE),
    )
    return sum((F.when(c, n).otherwise(0) for c, n in seen), F.lit(0))


_NEXT_TO_NUMBER = {"head": re.compile(tk.BEGINS_AFTER_NUMBER), "tail": re.compile(tk.ENDS_BEFORE_NUMBER)}
_BETWEEN = re.compile(tk.BETWEEN_NUMBERS, re.ASCII)
_DIGITS, _ASCII_LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def bits_of(end: str, text: str) -> int:
    """The same as ``_bits`` of one text."""
    parts = _DIGITS.split(text)
    between = _BETWEEN.sub("", parts[0] if end == "head" else parts[-1])
    return DIGIT * (len(parts) > 1) + NEXT_TO_NUMBER * bool(_NEXT_TO_NUMBER[end].search(text)) + BARE * (not _ASCII_LETTER.search(between))


def page_ends(pages: DataFrame, window: int = tk.CROSS_PAGE_WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, page_num, head, tail, tail_start, size) of pages, at most ``window`` characters of each end, and the columns to keep."""
    return pages.select(
        "file_id",
        F.col("page_num").cast("int"),
        F.substring("text", 1, window).alias("head"),
        F.right(F.col("text"), F.lit(window)).alias("tail"),
        F.greatest(F.lit(0), F.length("text") - window).alias("tail_start"),
        F.length("text").alias("size"),
        *keep,
    )


def in_blocks(ends: DataFrame, block_pages: int = BLOCK_PAGES) -> bool:
    """Whether any page lies beyond the first block of page numbers; of written ends the files' statistics mostly tell."""
    return not ends.where((F.col("page_num") < 0) | (F.col("page_num") >= block_pages)).isEmpty()


def page_breaks(ends: DataFrame, block_pages: int = BLOCK_PAGES, blocks: bool = True) -> DataFrame:
    """(file_id, page_num, head, prev_page, tail, tail_start) of the breaks before a page that may lie within a pair.

    Pages are dealt by blocks of page numbers, never by file alone: the last page of a block is copied into the next block
    that has pages, so that each page meets the one before it; where all pages lie in the first block (``blocks`` is false), there is
    nothing to copy. Ends that no pair can use are dropped before the shuffle. Ends with head_bits and tail_bits are not told anew.
    """
    told = [F.coalesce(c, _bits(c[:4])).alias(c) if c in ends.columns else _bits(c[:4]).alias(c) for c in _BITS]
    usable = lambda c: F.when(F.col(f"{c}_bits").bitwiseAND(DIGIT | NEXT_TO_NUMBER) > 0, F.col(c)).alias(c)
    own = ends.select("file_id", "page_num", F.floor(F.col("page_num") / block_pages).cast("int").alias("block"), "tail_start", "head", "tail", *told)
    own = own.select("file_id", "page_num", "block", "tail_start", usable("head"), usable("tail"), *_BITS, F.lit(False).alias("halo"))
    if blocks:
        last = own.groupBy("file_id", "block").agg(F.max_by(F.struct("page_num", "tail_start", "tail", "tail_bits"), "page_num").alias("last"))
        to = F.lead("block").over(Window.partitionBy("file_id").orderBy("block"))
        halo = last.withColumn("to", to).where("to is not null").select(
            "file_id", "last.page_num", F.col("to").alias("block"), "last.tail_start", F.lit(None).cast("string").alias("head"), "last.tail", F.lit(None).cast("int").alias("head_bits"), "last.tail_bits", F.lit(True).alias("halo")
        )
        own = own.unionByName(halo)
    order = Window.partitionBy("file_id", "block").orderBy("page_num")
    before = F.lag(F.struct(F.col("page_num").alias("prev_page"), "tail", "tail_start", "tail_bits")).over(order)
    met = own.select("file_id", "page_num", "head", "head_bits", "halo", before.alias("before")).where("not halo").select("file_id", "page_num", "head", "head_bits", "before.*")
    # A pair may span the break if no words but those of coordinates stand between the last number before and the first after
    # it, or such a word or white space ends the tail or begins the head.
    has = lambda c, bits: F.col(f"{c}_bits").bitwiseAND(bits) == bits
    may = (has("head", DIGIT) & has("tail", NEXT_TO_NUMBER)) | (has("tail", DIGIT) & has("head", NEXT_TO_NUMBER)) | (has("tail", DIGIT | BARE) & has("head", DIGIT | BARE))
    return met.where(F.col("tail").isNotNull() & F.col("head").isNotNull() & may).select("file_id", "page_num", "head", "prev_page", "tail", "tail_start")


_EDGES = [T.StructField(c, T.IntegerType()) for c in ("prev_page", "tail_start", "edge")]
_SPANNING = T.StructType([*PAIRS.fields, *_EDGES])


def _over(text: str, level: int, edge: int) -> list[tuple[tk.Token, tk.Token, int]]:
    """Pairs of a joint text that begin before the break and end after it, with their places among its pairs."""
    return [(lat, lon, i) for i, (lat, lon) in enumerate(tk.extract(text, level)) if lat and lon and min(lat.start, lon.start) < edge and max(lat.end, lon.end) > edge + 1]


def _read_breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of joint texts that span the break."""
    for batch in batches:
        row, index, tokens = read_once(batch, ("text", "level", "edge"), 2, _over)
        own = {c: batch.column(c).take(pa.array(row)) for c in ("file_id", "page_num", "prev_page", "tail_start", "edge")}
        made = own | {"pair_idx": index, "lat": tokens[0], "lon": tokens[1]}
        yield pa.RecordBatch.from_arrays([made[c] for c in _SPANNING.names], names=_SPANNING.names)


def leveled(texts: DataFrame, files: DataFrame | None, level: int) -> DataFrame:
    """Texts with the level of their file, else the general one; texts with a level of their own keep it."""
    if "level" in texts.columns:
        return texts
    if files is None:
        return texts.withColumn("level", F.lit(level))
    return texts.join(files.select("file_id", effective_intensity(level).alias("level")), "file_id", "left").withColumn("level", F.coalesce("level", F.lit(level)))


def break_texts(ends: DataFrame, files: DataFrame | None = None, level: int = tk.DEFAULT_LEVEL, block_pages: int = BLOCK_PAGES, blocks: bool = True) -> DataFrame:
    """(file_id, page_num, prev_page, tail_start, edge, text, level) of the breaks that may lie within a pair: the text is the
    tail before and the head after, and edge is where it breaks."""
    joint = page_breaks(ends, block_pages, blocks).select("file_id", "page_num", "prev_page", "tail_start", F.length("tail").alias("edge"), F.concat("tail", F.lit("\n"), "head").alias("text"))
    return leveled(joint, files, level)


def in_both_pages() -> Column:
    """Whether a pair of a break's text begins before the break and ends after it."""
    begin, end = F.least("lat.start", "lon.start"), F.greatest("lat.end", "lon.end")
    return F.col("lat").isNotNull() & F.col("lon").isNotNull() & (begin < F.col("edge")) & (end > F.col("edge") + 1)


def with_segments(found: DataFrame) -> DataFrame:
    """Pairs over breaks with the ranges of their halves on the pages."""
    return found.select("file_id", "page_num", "pair_idx", "lat", "lon", _segments("lat").alias("lat_segs"), _segments("lon").alias("lon_segs"))


def pairs_over_breaks(ends: DataFrame, files: DataFrame | None = None, level: int = tk.DEFAULT_LEVEL, block_pages: int = BLOCK_PAGES, blocks: bool = True) -> DataFrame:
    """The pairs of ``extract_cross_page`` from the pages' ends."""
    return with_segments(break_texts(ends, files, level, block_pages, blocks).mapInArrow(_read_breaks, _SPANNING))


def extract_cross_page(pages: DataFrame, files: DataFrame | None = None, level: int = tk.DEFAULT_LEVEL, window: int = tk.CROSS_PAGE_WINDOW) -> DataFrame:
    """(file_id, page_num, pair_idx, lat, lon, lat_segs, lon_segs) of pairs that span a page break.

    page_num is the later page. Only the pages' heads and tails and lengths are shuffled, by blocks of pages, and only breaks
    that may lie within a pair are read.
    """
    return pairs_over_breaks(page_ends(pages, window), files, level)


_FOUND = T.ArrayType(T.StructType(PAIRS.fields[2:]))
_ENDS = [*_KEYS, T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("tail_start", "size", *_BITS))]
_READ = T.StructType([*_ENDS, T.StructField("pairs", _FOUND)])


def read_pages(pages: DataFrame, files: DataFrame | None = None, level: int = tk.DEFAULT_LEVEL, window: int = tk.CROSS_PAGE_WINDOW) -> tuple[DataFrame, DataFrame]:
    """(pairs of ``extract_coordinates``, ends of ``page_ends`` with their bits) from one pass over the texts, written once, a row
    a page. Ends that no pair can use are null. Equal texts of a batch are read once."""
    pages = leveled(pages, files, level)

    def ends_of(texts: pa.Array) -> list[pa.Array]:
        size = pc.utf8_length(texts)
        start = pc.max_element_wise(pc.subtract(size, pa.scalar(window, pa.int32())), pa.scalar(0, pa.int32()))
        told = []
        for end, cut in (("head", pc.utf8_slice_codeunits(texts, 0, window)), ("tail", pc.utf8_slice_codeunits(texts, -window))):
            bits = pa.array([None if t is None else bits_of(end, t) for t in cut.to_pylist()], pa.int32())
            usable = pc.greater(pc.bit_wise_and(bits, pa.scalar(DIGIT | NEXT_TO_NUMBER, pa.int32())), 0)
            told.append((pc.if_else(usable, cut, pa.scalar(None, cut.type)), bits))
        return [told[0][0], told[1][0], start, size, told[0][1], told[1][1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, first = _different(batch, ("text",))
            ends = ends_of(batch.column("text").take(pa.array(first)))
            row, index, tokens = read_once(batch, ("text", "level"), 2, lambda text, own: tk.extract(text, own) if text else [])
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            pairs = pa.StructArray.from_arrays([index, *tokens], fields=list(to_arrow_type(_FOUND).value_type))
            found = pa.ListArray.from_arrays(offsets, pairs, type=to_arrow_type(_FOUND))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("page_num"), *(e.take(pa.array(code)) for e in ends), found], names=_READ.names)

    read = written(pages.select("file_id", F.col("page_num").cast("int").alias("page_num"), "text", "level").mapInArrow(run, _READ), "read")
    return read.select("file_id", "page_num", F.inline("pairs")), read.select(*(f.name for f in _ENDS))


def halves(pairs: DataFrame) -> DataFrame:
    """One row per half of each pair: its location key, end, token and the key of its pair."""
    both = F.array(*(F.struct(F.lit(h).alias("half"), F.col(h).alias("token")) for h in ("lat", "lon")))
    out = pairs.select("file_id", "page_num", "pair_idx", F.inline(both)).where("token is not null")
    return out.select("file_id", "page_num", "pair_idx", "half", "token.start", "token.end", "token")


def drop_suppressed(pairs: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Pairs of which no half lies at a suppressed location (file_id, page_num, half, start)."""
    gone = halves(pairs).join(suppressed, ["file_id", "page_num", "half", "start"], "left_semi")
    return pairs.join(gone.select("file_id", "page_num", "pair_idx").distinct(), ["file_id", "page_num", "pair_idx"], "left_anti")


def _first(half: str) -> list[Column]:
    seg = F.get(f"{half}_segs", F.lit(0))
    return [seg["page_num"].alias(f"{half}_page"), seg["start"].alias(f"{half}_start"), seg["end"].alias(f"{half}_end")]


def _earlier(nodes: str) -> Column:
    """Each of the sorted nodes of one place with all that come before it; there are two on real pages, one of each break."""
    pairs = F.transform(nodes, lambda x, i: F.transform(F.slice(nodes, F.lit(1), i), lambda y: F.struct(x.alias("node"), y.alias("earlier"))))
    return F.flatten(pairs)


def settle_shared(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``nodes`` (node), those that taking them in order keeps, if a node is kept unless one linked to it is that comes before:
    ``links`` are (node, earlier). The distinct nodes that are kept.

    Where a node has one earlier neighbour at most, it is kept if its chain has an even number of links to its end. Chains are ranked
    by pointer doubling: in each round every node takes over its pointer's pointer, so a chain of any length takes as many
    rounds as its length has binary digits, whatever the number of chains. A node with more earlier neighbours ends the chains
    behind it until theirs are known.
    """
    known = None
    todo = written(nodes.select("node").distinct().join(links.distinct().groupBy("node").agg(F.count("*").alias("n"), F.min("earlier").alias("up")), "node", "left").withColumn("lost", F.lit(False)), "chain")
    while True:
        # A pointer that is null has reached an end; "odd" says whether the way there has an odd number of links. Nodes with
        # several earlier neighbours are ends of unknown outcome; those known to be lost are ends that count as odd.
        up = F.when(~F.col("lost"), F.col("up"))
        free = todo.where("lost or n is null or n = 1").select("node", up.alias("up"), (F.col("lost") | up.isNotNull()).alias("odd"), F.lit(None).cast("string").alias("join"))
        joins = todo.where("not lost and n > 1").select("node", F.lit(None).cast("string").alias("up"), F.lit(False).alias("odd"), F.col("node").alias("join"))
        chain = written(free.union(joins), "chain")
        while not chain.where("up is not null").isEmpty():
            ahead = chain.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("odd").alias("__odd"), F.col("join").alias("__join"))
            open_ = chain.where("up is not null").join(ahead, "up", "left")
            moved = open_.select("node", F.col("__up").alias("up"), (F.col("odd") != F.coalesce("__odd", F.lit(False))).alias("odd"), F.coalesce("join", "__join").alias("join"))
            chain = written(chain.where("up is null").union(moved), "chain")
        settled = chain.where("join is null").select("node", (~F.col("odd")).alias("keep"))
        known = settled if known is None else known.union(settled)
        rest = chain.where("join is not null").select("node")
        if rest.isEmpty():
            return known.where("keep").select("node")
        known = written(known, "settled")
        around = links.distinct().join(rest, "node", "left_semi").join(known.withColumnRenamed("node", "earlier"), "earlier", "left")
        # A kept earlier neighbour settles a node; else what remains are the neighbours still unknown.
        per = around.groupBy("node").agg(F.max("keep").alias("lost"), F.count_if(F.col("keep").isNull()).alias("n"), F.min(F.when(F.col("keep").isNull(), F.col("earlier"))).alias("up"))
        todo = written(per.select("node", F.nullif("n", F.lit(0)).alias("n"), "up", F.coalesce("lost", F.lit(False)).alias("lost")), "chain")


def first_places(cross: DataFrame) -> DataFrame:
    """(file_id, page_num, pair_idx, half, at, start, end) of the first segment of each half of cross pairs."""
    key = ["file_id", "page_num", "pair_idx"]
    firsts = cross.select(*key, *_first("lat"), *_first("lon"))
    both = F.array(*(F.struct(F.lit(h).alias("half"), *(F.col(f"{h}_{c}").alias(n) for c, n in (("page", "at"), ("start", "start"), ("end", "end")))) for h in ("lat", "lon")))
    return firsts.select(*key, F.inline(both))


def merge_cross_page(pairs: DataFrame, cross: DataFrame, suppressed: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page pairs, cross pairs) after merging. ``held`` (file_id, at, start, end) are places that earlier cross pairs have.

    A cross pair is dropped if its first segments hold a token of a full pair (an earlier cross pair's
    included) or lie at a suppressed location; otherwise the lone halves at them are absorbed. Cross pairs that
    share a token with another form chains over the breaks of a file, which are settled by pointer doubling, so neither many
    files nor a large one is a burden.
    """
    key = ["file_id", "page_num", "pair_idx"]
    spots = first_places(cross)
    taken = halves(pairs.where("lat is not null and lon is not null")).select("file_id", F.col("page_num").alias("at"), "start", "end")
    if held is not None:
        taken = taken.union(held.select("file_id", "at", "start", "end"))
    redundant = spots.join(taken, ["file_id", "at", "start", "end"], "left_semi").select(key)
    hidden = spots.join(suppressed.withColumnRenamed("page_num", "at"), ["file_id", "at", "half", "start"], "left_semi").select(key)
    free = written(cross.select(key).join(redundant.union(hidden), key, "left_anti"), "free")

    # The key as text, in the order in which pairs are taken within a file.
    node = F.concat_ws(":", F.lpad("page_num", 10, "0"), F.lpad("pair_idx", 10, "0"), "file_id")
    place = ["file_id", "at", "start", "end"]
    open_ = written(spots.join(free.select(key), key, "left_semi").select(*place, node.alias("node"), *key[1:]).distinct(), "spots")
    shared = open_.groupBy(*place).agg(F.array_sort(F.collect_set("node")).alias("nodes")).where(F.size("nodes") > 1)
    links = written(shared.select(F.explode(_earlier("nodes")).alias("link")).select("link.node", "link.earlier"), "links")
    if links.isEmpty():
        kept = free
    else:
        contested = links.select("node").union(links.select("earlier")).distinct()
        lost = contested.join(settle_shared(links, contested), "node", "left_anti")
        kept = free.withColumn("node", node).join(lost, "node", "left_anti").select(key)
    accepted = cross.join(kept, key, "left_semi")
    at = spots.join(kept, key, "left_semi").select("file_id", F.col("at").alias("page_num"), "start", "end").distinct()
    # Full pairs stay as they are, so only lone halves are shuffled; each is one token.
    lone, token = pairs.where("lat is null or lon is null"), F.coalesce("lat", "lon")
    left = lone.withColumns({"start": token["start"], "end": token["end"]}).join(at, ["file_id", "page_num", "start", "end"], "left_anti")
    return pairs.where("lat is not null and lon is not null").union(left.select(*pairs.columns)), accepted


def located(pairs: DataFrame, cross: DataFrame) -> DataFrame:
    """One row per coordinate: row_id, file_id, page_num (of the latitude), order columns, lat, lon, and the
    detected halves with their segments."""
    segs = lambda h: F.array(F.struct(F.col("page_num"), F.col(f"{h}.start").alias("start"), F.col(f"{h}.end").alias("end")))
    own = pairs.select(
        "file_id", "page_num", F.col("page_num").alias("scan_page"), F.lit(0).alias("is_cross"), "pair_idx", "lat", "lon",
        F.when(F.col("lat").isNotNull(), segs("lat")).alias("lat_segs"), F.when(F.col("lon").isNotNull(), segs("lon")).alias("lon_segs"),
    )
    over = cross.select(
        "file_id", F.get("lat_segs", F.lit(0))["page_num"].alias("page_num"), F.col("page_num").alias("scan_page"), F.lit(1).alias("is_cross"), "pair_idx", "lat", "lon", "lat_segs", "lon_segs"
    )
    row_id = F.concat_ws(":", "file_id", "scan_page", "is_cross", "pair_idx")
    return own.unionByName(over).withColumn("row_id", row_id)


def build_detections(coords: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """One detection per half and segment: det_id, file_id, page_num, half, seg, start, end, raw, row_id, rects."""
    both = F.array(*(F.struct(F.lit(h).alias("half"), F.col(f"{h}.raw").alias("raw"), F.col(f"{h}_segs").alias("segs")) for h in ("lat", "lon")))
    parts = coords.select("row_id", "file_id", F.inline(both)).where("segs is not null")
    dets = parts.select("row_id", "file_id", "half", "raw", F.posexplode("segs").alias("seg", "at"))
    dets = dets.select(
        F.concat_ws(":", "file_id", "at.page_num", "half", "at.start").alias("det_id"), "file_id", "at.page_num", "half", "seg", "at.start", "at.end", "raw", "row_id"
    )
    if spans is None:
        return dets.withColumn("rects", F.lit(None).cast("array<array<double>>"))
    boxes = rects_for_range(spans, dets.select("det_id", "file_id", "page_num", "start", "end"))
    return dets.join(boxes, "det_id", "left")


ROW_COLUMNS = ["row_id", "file_id", "page_num", "scan_page", "is_cross", "pair_idx", "cells", "notes", "lat", "lon", "lat_raw", "lon_raw"]


def fresh_rows(coords: DataFrame, n_cols: int = 2) -> DataFrame:
    """New table rows of located coordinates: blank cells and notes, values from the halves."""
    nothing = F.lit(None).cast("string")
    return coords.select(
        "row_id", "file_id", "page_num", "scan_page", "is_cross", "pair_idx",
        F.array_repeat(F.lit(""), n_cols).alias("cells"), F.lit("").alias("notes"),
        F.col("lat.dd").alias("lat"), F.col("lon.dd").alias("lon"), nothing.alias("lat_raw"), nothing.alias("lon_raw"),
    )


def merged_coordinates(own: DataFrame, cross: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Located coordinates of page pairs and cross-page pairs, without suppressed ones, written."""
    return written(located(*merge_cross_page(drop_suppressed(own, suppressed), cross, suppressed)), "coordinates")


def scan_coordinates(pages: DataFrame, files: DataFrame, suppressed: DataFrame, level: int = tk.DEFAULT_LEVEL) -> DataFrame:
    """Located coordinates of a corpus: page pairs and cross-page pairs, without suppressed ones. Texts are read once for
    both; what was found is written before it is merged."""
    own, ends = read_pages(pages, files, level)
    cross = written(pairs_over_breaks(ends, files, level, blocks=in_blocks(ends)), "cross-pairs")
    return merged_coordinates(own, cross, suppressed)


def scan_corpus(pages: DataFrame, files: DataFrame, suppressed: DataFrame, n_cols: int = 2, level: int = tk.DEFAULT_LEVEL, spans: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, detections) of a whole corpus."""
    coords = scan_coordinates(pages, files, suppressed, level)
    return fresh_rows(coords, n_cols), build_detections(coords, spans)
