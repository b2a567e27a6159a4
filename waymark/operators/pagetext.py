"""Page text from positioned text items, the items' character ranges, and boxes of ranges.

Items are (file_id, page_num, item_seq, str, has_eol, x, y, width, height).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Share of the height that makes a new line, a gap; height of items without one.
NEW_LINE, GAP, HEIGHT = 0.75, 0.12, 8.0
BELOW, ABOVE = 0.28, 1.02


def _height(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, HEIGHT).otherwise(c)


def pieces(items: DataFrame) -> DataFrame:
    """Items with the text that each adds: divider, own text, line end."""
    order = Window.partitionBy("file_id", "page_num").orderBy("item_seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.length(F.coalesce("str", F.lit(""))) > 0
    me = F.struct("x", "y", F.coalesce("width", F.lit(0.0)).alias("width"), _height("height").alias("height"))
    eol = F.coalesce("has_eol", F.lit(False))
    # After an item, the text ends in a line end if the item adds one or its own text ends so.
    closes = F.when(filled, eol | F.col("str").endswith("\n")).when(eol, F.lit(True))
    marked = items.withColumns({"prev": F.last(F.when(filled, me), True).over(earlier), "closed": F.last(closes, True).over(earlier), "filled": filled, "eol": eol})
    prev = F.col("prev")
    gap = F.col("x") - (prev["x"] + prev["width"])
    divider = (
        F.when(prev.isNull() | F.coalesce("closed", F.lit(False)), "")
        .when(F.abs(F.col("y") - prev["y"]) > prev["height"] * NEW_LINE, "\n")
        .when(gap > prev["height"] * GAP, " ")
        .otherwise("")
    )
    end = F.when(F.col("eol"), "\n").otherwise("")
    # An empty item closes a line only if there is text and it is open.
    lone = F.when(F.col("eol") & prev.isNotNull() & ~F.coalesce("closed", F.lit(False)), "\n").otherwise("")
    return marked.withColumn("divider", F.when(F.col("filled"), divider).otherwise("")).withColumn(
        "piece", F.when(F.col("filled"), F.concat("divider", "str", end)).otherwise(lone)
    )


def placed_pieces(items: DataFrame) -> DataFrame:
    """(file_id, page_num, item_seq, piece, filled, start, end, x, y, width, height): what items add to the text, and the range of their own text."""
    order = Window.partitionBy("file_id", "page_num").orderBy("item_seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0))
    made = pieces(items).withColumn("start", (before + F.length("divider")).cast("int"))
    return made.select(
        "file_id", "page_num", "item_seq", "piece", "filled", "start", (F.col("start") + F.length("str")).alias("end"), "x", "y", F.coalesce("width", F.lit(0.0)).alias("width"), _height("height").alias("height")
    )


def text_of_pieces(placed: DataFrame) -> DataFrame:
    """(file_id, page_num, text) of pages of pieces."""
    parts = F.sort_array(F.collect_list(F.struct("item_seq", "piece")))
    return placed.groupBy("file_id", "page_num").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))


def spans_of_pieces(placed: DataFrame) -> DataFrame:
    """(file_id, page_num, item_seq, start, end, x, y, width, height) of every piece with text of its own."""
    return placed.where("filled").select("file_id", "page_num", "item_seq", "start", "end", "x", "y", "width", "height")


def build_page_text(items: DataFrame) -> DataFrame:
    """(file_id, page_num, text) of pages of items."""
    return text_of_pieces(pieces(items))


def page_spans(items: DataFrame) -> DataFrame:
    """(file_id, page_num, item_seq, start, end, x, y, width, height) of every item with text. Shares the
    exchange by page with build_page_text."""
    return spans_of_pieces(placed_pieces(items))


#: Characters of a bin; ranges of more than WIDER bins go into bins WIDER times as wide.
BIN, WIDER = 256, 256


def _in_bins(df: DataFrame, start: str, end: str, first: str) -> DataFrame:
    """A row for each bin that [start, end) touches, with the first of them; an empty range touches that of its start."""
    at = F.floor(F.col(start) / F.col("bin_width"))
    last = F.floor(F.greatest(F.col(start), F.col(end) - 1) / F.col("bin_width"))
    return df.withColumns({first: at, "bin": F.explode(F.sequence(at, last))})


def rects_for_range(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """(det_id, rects): for each range (det_id, file_id, page_num, start, end) the boxes [x1, y1, x2, y2] of all
    items it touches, in order.

    Items and ranges meet in bins of offsets, a pair counting in the first bin that both touch. So a range is compared with the
    items near it alone, and a page of any size is spread over tasks. Long ranges meet the items in wider bins.
    """
    page = ["file_id", "page_num"]
    r = ranges.select("det_id", *page, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    is_long = F.col("r_end") - F.col("r_start") > BIN * WIDER
    r = r.withColumn("bin_width", F.when(is_long, BIN * WIDER).otherwise(BIN))
    if r.where(is_long).isEmpty():
        # One width serves all, so items go straight to their bins.
        some = spans.withColumn("bin_width", F.lit(BIN))
    else:
        some = spans.join(r.select(*page, "bin_width").distinct(), page)
    met = _in_bins(some, "start", "end", "s_first").join(_in_bins(r, "r_start", "r_end", "r_first"), [*page, "bin_width", "bin"])
    hit = met.where((F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end")) & (F.col("bin") == F.greatest("s_first", "r_first")))
    size = F.col("end") - F.col("start")
    at = lambda c: F.col("x") + F.col("width") * (c - F.col("start")) / size
    box = F.array(at(F.greatest("r_start", "start")), F.col("y") - F.col("height") * BELOW, at(F.least("r_end", "end")), F.col("y") + F.col("height") * ABOVE)
    boxes = F.sort_array(F.collect_list(F.struct("start", box.alias("box"))))
    return hit.groupBy("det_id").agg(F.transform(boxes, lambda b: b["box"]).alias("rects"))
