"""A stored index of places in the table's order.

Rows are cut into ranges of their order once. Stored are each range's first place and, for each range and file, how many rows
it has; later changes are appended as differences. The visible row of a number is then found from sums over the
ranges and one range's rows: hiding files changes no count, and no row is sorted or numbered but those of a range.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..sources.shared import written
from .rows import _changed, row_seq, visible_rows

#: Most hidden files that are broadcast to the table.
BROADCAST_FILES = 500_000
CHANGES = "part long, file_id string, n long"


def _key() -> Column:
    return F.struct("row_seq", "row_id")


def _place(key: Row) -> Column:
    return F.struct(row_seq(*(F.lit(v) for v in key["row_seq"])).alias("row_seq"), F.lit(key["row_id"]).cast("string").alias("row_id"))


def build_ranks(rows: DataFrame, base: str, per_range: int = 65_536) -> None:
    """Store the index of ``rows`` in the new folder ``base``, in ranges of about ``per_range`` rows. Only keys are sorted, in ranges.

    Rows of equal row_seq are in the order of row_id. An empty table gives an index of one range.
    """
    keys = rows.select("row_seq", "row_id", "file_id")
    n = max(1, -(-keys.count() // per_range))
    placed = keys.repartitionByRange(n, "row_seq", "row_id").withColumn("part", F.spark_partition_id().cast("long"))
    placed = written(placed, "places")
    placed.groupBy("part").agg(F.min(_key()).alias("low")).write.mode("error").parquet(f"{base}/ranges")
    placed.groupBy("part", "file_id").agg(F.count("*").alias("n")).write.mode("error").parquet(f"{base}/changes")


def _lows(spark: SparkSession, base: str) -> list[Row]:
    """The ranges in order, one row each."""
    return spark.read.parquet(f"{base}/ranges").orderBy("part").collect()


def note_changes(rows: DataFrame, base: str, sign: int) -> None:
    """Append to the index that ``rows`` (with row_seq, row_id, file_id) were added (sign 1) or removed (-1), once for each change.

    Each row's range is found by bisection, in Arrow batches; the table itself is not read. One
    append is one commit, so a write that failed counts for nothing and may be repeated.
    """
    ranges = _lows(rows.sparkSession, base)
    parts = [r["part"] for r in ranges] or [0]
    lows = [(*r["low"]["row_seq"], r["low"]["row_id"]) for r in ranges][1:]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip((tuple(s.values()) for s in batch.column("row_seq").to_pylist()), batch.column("row_id").to_pylist(), strict=True)
            at = [parts[bisect_right(lows, (*seq, row_id))] for seq, row_id in keys]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column("file_id")], names=["part", "file_id"])

    found = rows.select("row_seq", "row_id", "file_id").mapInArrow(find, "part long, file_id string")
    found.groupBy("part", "file_id").agg((F.count("*") * sign).alias("n")).write.mode("append").parquet(f"{base}/changes")


def places_of(rows: DataFrame, files: DataFrame, base: str, numbers: list[int]) -> list[Row | None]:
    """The places (row_seq, row_id) of the visible rows that have these numbers, from 1 on; none beyond the last row.

    Only one sum of each range reaches the driver. A number's range is read for rows between its bounds, the first few of
    which are kept in order; a range that has grown much makes a look-up slower, not wrong, until the index is built anew.
    """
    spark = rows.sparkSession
    changes = spark.read.schema(CHANGES).parquet(f"{base}/changes")
    sums = {r["part"]: r["n"] for r in visible_rows(changes, files).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    ranges = _lows(spark, base)
    out: list[Row | None] = []
    for number in numbers:
        before, found = 0, None
        for i, r in enumerate(ranges):
            n = sums.get(r["part"], 0)
            if before < number <= before + n:
                some = visible_rows(rows, files)
                if i:
                    some = some.where(_key() >= _place(r["low"]))
                if i + 1 < len(ranges):
                    some = some.where(_key() < _place(ranges[i + 1]["low"]))
                rest = some.select("row_seq", "row_id").orderBy("row_seq", "row_id").offset(number - before - 1).limit(1).collect()
                found = rest[0] if rest else None
                break
            before += n
        out.append(found)
    return out


def fill_range_by_ranks(rows: DataFrame, files: DataFrame, base: str, first: int, last: int, column: str, value: str) -> DataFrame:
    """What ``fill_range`` gives, by two look-ups in the index: rows between two places are filled where they lie, without
    a shuffle or sort of the table unless more than ``BROADCAST_FILES`` files are hidden. Numbers below 1 and beyond the last row are cut."""
    low, high = max(1, min(first, last)), max(first, last)
    start, end = places_of(rows, files, base, [low, high]) if high >= low else (None, None)
    if start is None:
        return rows
    hit = _key() >= _place(start)
    if end is not None:
        hit &= _key() <= _place(end)
    shown = F.col("__hidden").isNull()
    number = tk.parse_single(value, column) if column in ("lat", "lon") else None
    hidden = files.where("hidden").select("file_id", F.lit(True).alias("__hidden")).distinct()
    out = rows.join(F.broadcast(hidden) if hidden.count() <= BROADCAST_FILES else hidden, "file_id", "left")
    return out.withColumns(_changed(column, hit & shown, F.lit(value), F.lit(number).cast("double"))).select(*rows.columns)
