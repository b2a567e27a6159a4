"""The table of coordinate rows: visibility, deletion, re-scans, duplicates, numbering, fills, edits.

Rows are (row_id, row_seq, file_id, page_num, cells, notes, lat, lon, lat_raw, lon_raw, llm, llm_sent); a row
without file_id was added by hand. row_seq is an order: a struct of (kept, file_seq, scan_page, is_cross, pair_idx).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens as tk
from ..functions.columns import LOC_KEY, cell, cell_text, coord_part, has_coordinate, padded_cells, trim
from ..sources.shared import numbered, written
from .extract import halves

LLM = "struct<verdict:string,note:string,lat:double,lon:double,del:boolean>"


def row_seq(kept=0, file_seq=0, scan_page=0, is_cross=0, pair_idx=0) -> Column:
    """A row's place in the table's order."""
    c = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        c(kept, "int").alias("kept"), c(file_seq, "long").alias("file_seq"), c(scan_page, "int").alias("scan_page"), c(is_cross, "int").alias("is_cross"), c(pair_idx, "long").alias("pair_idx")
    )


def as_table_rows(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned rows with row_seq and empty review columns."""
    out = scanned.join(files.select("file_id", "file_seq"), "file_id")
    seq = row_seq(0, F.col("file_seq"), F.col("scan_page"), F.col("is_cross"), F.col("pair_idx"))
    return out.select(
        "row_id", seq.alias("row_seq"), "file_id", "page_num", "cells", "notes", "lat", "lon", "lat_raw", "lon_raw",
        F.lit(None).cast(LLM).alias("llm"), F.lit(None).cast("timestamp").alias("llm_sent"),
    )


def visible_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of files that are not hidden, and all rows added by hand."""
    return rows.join(files.where("hidden").select("file_id"), "file_id", "left_anti")


def remove_rows(rows: DataFrame, dets: DataFrame, suppressed: DataFrame, ids: DataFrame, suppress: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, detections, suppressed) without the rows of ``ids`` (row_id); the places of their detections
    stay suppressed in later scans, unless told otherwise."""
    gone = dets.join(ids.select("row_id"), "row_id", "left_semi")
    places = suppressed.select(*LOC_KEY)
    if suppress:
        places = places.union(gone.select(*LOC_KEY)).distinct()
    return rows.join(ids.select("row_id"), "row_id", "left_anti"), dets.join(ids.select("row_id"), "row_id", "left_anti"), places


def rescan_merge(old_rows: DataFrame, old_dets: DataFrame, coords: DataFrame, new_dets: DataFrame, fresh: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, detections) after running detection again.

    ``coords``: located new coordinates; ``fresh``: their new table rows; ``new_dets``: their detections. A
    coordinate at the place of an old latitude, else longitude, takes over that old row with its edits and old
    values; cross-page pairs claim first, then pairs in scan order; an old row goes to one claimant. Other old
    rows of scanned files vanish; rows added by hand and rows of files with an error are kept at the end.
    """
    scannable = files.where("error is null").select("file_id")
    old = old_rows.join(scannable, "file_id", "left_semi")
    keys = old_dets.where("seg = 0").join(old.select("row_id"), "row_id", "left_semi").select(*LOC_KEY, F.col("row_id").alias("old_id"))
    # Places come with the order of their coordinate, so that claims need not meet the coordinates again.
    first = F.struct((1 - F.col("is_cross")).alias("late"), "file_id", "scan_page", "pair_idx", "row_id")
    both = F.array(*(F.struct(F.lit(h).alias("half"), F.get(f"{h}_segs", F.lit(0)).alias("at")) for h in ("lat", "lon")))
    places = coords.select("file_id", first.alias("first"), F.inline(both)).where("at is not null").select("file_id", "at.page_num", "half", "at.start", "first")
    rank = F.when(F.col("half") == "lat", 0).otherwise(1)
    hit = places.join(keys, LOC_KEY).groupBy("first").agg(F.min(F.struct(rank.alias("rank"), "old_id"))["old_id"].alias("old_id"))
    given = written(hit.groupBy("old_id").agg(F.min("first")["row_id"].alias("row_id")), "claims")
    kept_values = old.select(F.col("row_id").alias("old_id"), *(F.col(c).alias(f"o_{c}") for c in ("cells", "notes", "lat", "lon", "lat_raw", "lon_raw", "llm", "llm_sent")))
    merged = fresh.join(given, "row_id", "left").join(kept_values, "old_id", "left")
    taken = F.col("old_id").isNotNull()
    values = [F.when(taken, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("cells", "notes", "lat", "lon", "lat_raw", "lon_raw", "llm", "llm_sent")]
    current = merged.select(F.coalesce("old_id", "row_id").alias("row_id"), "row_seq", "file_id", "page_num", *values)
    rest = old_rows.join(scannable, "file_id", "left_anti")
    s = F.col("row_seq")
    rest = rest.withColumn("row_seq", row_seq(1, s["file_seq"], s["scan_page"], s["is_cross"], s["pair_idx"]))
    dets = new_dets.join(given, "row_id", "left").withColumn("row_id", F.coalesce("old_id", "row_id")).drop("old_id")
    dets = dets.unionByName(old_dets.join(scannable, "file_id", "left_anti"), allowMissingColumns=True)
    return current.unionByName(rest.select(*current.columns)), dets


def _duplicate_key(same_cols: bool, same_pdf: bool) -> list[Column]:
    key = [coord_part(F.col("lat"), F.col("lat_raw")).alias("k_lat"), coord_part(F.col("lon"), F.col("lon_raw")).alias("k_lon")]
    if same_cols:
        key += [F.lower(trim(cell(i))).alias(f"k_{i}") for i in range(2)]
    if same_pdf:
        key.append(F.coalesce("file_id", F.lit("")).alias("k_file"))
    return key


def find_duplicates(rows: DataFrame, same_cols: bool = False, same_pdf: bool = False) -> DataFrame:
    """(row_id) of rows whose coordinate an earlier row has. The first row of each key is found by a grouping
    that combines before the shuffle, so a point that very many rows share is no burden."""
    keyed = rows.where(has_coordinate()).select("row_id", "row_seq", *_duplicate_key(same_cols, same_pdf))
    names = [c for c in keyed.columns if c.startswith("k_")]
    first = keyed.groupBy(*names).agg(F.min("row_seq").alias("first"))
    return keyed.join(first, names).where(F.col("row_seq") > F.col("first")).select("row_id")


def dedup_preview(rows: DataFrame, files: DataFrame, same_cols: bool = False, same_pdf: bool = False) -> DataFrame:
    """One row: n_duplicates among n_rows visible rows."""
    shown = visible_rows(rows, files)
    twice = find_duplicates(shown, same_cols, same_pdf).withColumn("twice", F.lit(1))
    return shown.select("row_id").join(twice, "row_id", "left").agg(F.count("twice").alias("n_duplicates"), F.count("*").alias("n_rows"))


def remove_duplicates(rows: DataFrame, dets: DataFrame, suppressed: DataFrame, files: DataFrame, same_cols: bool = False, same_pdf: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return remove_rows(rows, dets, suppressed, find_duplicates(visible_rows(rows, files), same_cols, same_pdf))


def number_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``num``, their place from 1 on in the order of row_seq. They are ordered in ranges, so neither many files
    nor a large one comes into one task."""
    return numbered(rows, "row_seq", "row_id")


@F.pandas_udf(T.DoubleType())
def _parse_lat(values: pd.Series) -> pd.Series:
    return values.map(lambda v: tk.parse_single(v, "lat"), na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def _parse_lon(values: pd.Series) -> pd.Series:
    return values.map(lambda v: tk.parse_single(v, "lon"), na_action="ignore").astype("float64")


def parse_single(rows: DataFrame, text: str, axis: str, name: str) -> DataFrame:
    """Rows with ``name``, the typed value in the column ``text`` in decimal degrees, null where it is none or out of
    range. Plain numbers are cast; only rows with other texts go through Python."""
    s = trim(F.col(text))
    other = F.coalesce((s != "") & ~F.regexp_like(s, F.lit(r"^[+-]?[0-9]{1,3}(\.[0-9]+)?$")), F.lit(False))
    value = s.try_cast("double")
    plain = rows.where(~other).withColumn(name, F.when(F.abs(value) <= (90 if axis == "lat" else 180), value))
    read = (_parse_lat if axis == "lat" else _parse_lon)(s)
    return plain.unionByName(rows.where(other).withColumn(name, F.when(~F.isnan(read), read)))


def _set_cell(i: Column | int, value: Column) -> Column:
    wanted = i if isinstance(i, Column) else F.lit(i)
    return F.transform("cells", lambda x, j: F.when(j == wanted, value).otherwise(x))


def _changed(column: str, hit: Column, value: Column, number: Column) -> dict[str, Column]:
    """The columns of rows after ``value`` was typed into ``column`` ('notes', 'lat', 'lon', or a cell's number) where
    ``hit``; ``number`` is what a typed coordinate is read as."""
    if column in ("lat", "lon"):
        blank = trim(F.coalesce(value, F.lit(""))) == ""
        return {
            column: F.when(hit, F.when(~blank, number)).otherwise(F.col(column)),
            f"{column}_raw": F.when(hit, F.when(~blank & number.isNull(), value)).otherwise(F.col(f"{column}_raw")),
        }
    if column == "notes":
        return {"notes": F.when(hit, value).otherwise(F.col("notes"))}
    return {"cells": F.when(hit, _set_cell(int(column), value)).otherwise(F.col("cells"))}


def apply_edits(rows: DataFrame, edits: DataFrame, columns: tuple[str, ...] = ("0", "1", "notes", "lat", "lon")) -> DataFrame:
    """Rows after edits (row_id, column, value), one per row and column. Texts are set verbatim; a coordinate's
    blank clears it, a value that is understood is set, any other text is kept as typed. The edits are read and brought
    into one row each, then joined once."""
    typed = edits.select("row_id", "column", F.coalesce("value", F.lit("")).alias("value"))
    other = typed.where(~F.col("column").isin("lat", "lon")).withColumn("number", F.lit(None).cast("double"))
    for axis in ("lat", "lon"):
        if axis in columns:
            other = other.unionByName(parse_single(typed.where(F.col("column") == axis), "value", axis, "number"))
    per_row = other.groupBy("row_id").agg(*(F.max(F.when(F.col("column") == c, F.struct("value", "number"))).alias(f"__{c}") for c in columns))
    out = rows.join(per_row, "row_id", "left")
    for c in columns:
        e = F.col(f"`__{c}`")
        out = out.withColumns(_changed(c, e.isNotNull(), e["value"], e["number"]))
    return out.select(*rows.columns)


def fill_range(rows: DataFrame, files: DataFrame, first: int, last: int, column: str, value: str) -> DataFrame:
    """One value in a data or notes column of the visible rows numbered first to last, either way round."""
    numbers = number_rows(visible_rows(rows, files)).where(F.col("num").between(min(first, last), max(first, last))).select("row_id")
    return fill_rows(rows, numbers, column, value)


def fill_rows(rows: DataFrame, ids: DataFrame, column: str, value: str) -> DataFrame:
    """One value in a column of the rows of ``ids`` (row_id); on a coordinate it is read, once, as typed text."""
    number = tk.parse_single(value, column) if column in ("lat", "lon") else None
    out = rows.join(ids.select("row_id").distinct().withColumn("__hit", F.lit(True)), "row_id", "left")
    return out.withColumns(_changed(column, F.coalesce("__hit", F.lit(False)), F.lit(value), F.lit(number).cast("double"))).drop("__hit")


def fill_from_above(rows: DataFrame, files: DataFrame, ids: DataFrame, column: str, fmt: str = "dd") -> DataFrame:
    """The rows of ``ids`` take the shown text of the visible row above, as it was before. The first visible row
    has none above and stays. Only the texts that are taken are read."""
    shown = number_rows(visible_rows(rows, files))
    if column in ("lat", "lon"):
        text = cell_text(column, "dms" if fmt == "dms" else "dd", fmt)
    else:
        text = F.coalesce("notes", F.lit("")) if column == "notes" else cell(int(column))
    above = shown.select((F.col("num") + 1).alias("num"), text.alias("value"))
    own = shown.select("row_id", "num").join(ids.select("row_id").distinct(), "row_id", "left_semi").join(above, "num")
    return apply_edits(rows, own.select("row_id", F.lit(column).alias("column"), "value"), (column,))


def add_row(rows: DataFrame, row_id: str, n_cols: int = 2) -> DataFrame:
    """A blank row at the end, without a source."""
    last = rows.agg(F.coalesce(F.max("row_seq.file_seq"), F.lit(0)).alias("f"), F.coalesce(F.max("row_seq.pair_idx"), F.lit(0)).alias("p"))
    blank = last.select(
        F.lit(row_id).alias("row_id"), row_seq(2, F.col("f"), 0, 0, F.col("p") + 1).alias("row_seq"), F.array_repeat(F.lit(""), n_cols).alias("cells"), F.lit("").alias("notes")
    )
    return rows.unionByName(blank, allowMissingColumns=True)


def add_column(rows: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Cells widened by one, with the next general header."""
    return rows.withColumn("cells", padded_cells(len(cols) + 1)), [*cols, f"Field {len(cols) + 1}"]


def drop_column(rows: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Without the last data column; two always stay."""
    left = cols[:-1] if len(cols) > 2 else cols
    return rows.withColumn("cells", padded_cells(len(left))), list(left)


def rename_column(cols: list[str], i: int, name: str) -> list[str]:
    return [name if j == i else c for j, c in enumerate(cols)]


def delete_flagged(rows: DataFrame, dets: DataFrame, suppressed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the visible rows that a review flagged for deletion."""
    return remove_rows(rows, dets, suppressed, visible_rows(rows, files).where("llm.del").select("row_id"))


def apply_suggestions(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The listed rows with verdict 'mismatch' take the suggested values; their verdict becomes 'ok'."""
    out = rows.join(ids.select("row_id").distinct().withColumn("__hit", F.lit(True)), "row_id", "left")
    some = F.col("llm.lat").isNotNull() | F.col("llm.lon").isNotNull()
    hit = F.coalesce("__hit", F.lit(False)) & (F.col("llm.verdict") == "mismatch") & some
    hit = F.coalesce(hit, F.lit(False))
    changes = {}
    for half in ("lat", "lon"):
        given = hit & F.col(f"llm.{half}").isNotNull()
        changes[half] = F.when(given, F.col(f"llm.{half}")).otherwise(F.col(half))
        changes[f"{half}_raw"] = F.when(given, F.lit(None)).otherwise(F.col(f"{half}_raw"))
    changes["llm"] = F.when(hit, F.col("llm").withField("verdict", F.lit("ok"))).otherwise(F.col("llm"))
    return out.withColumns(changes).drop("__hit")


def hide_files(files: DataFrame, ids: list[str], hidden: bool = True) -> DataFrame:
    return files.withColumn("hidden", F.when(F.col("file_id").isin(ids), hidden).otherwise(F.col("hidden")))


def set_file_net(files: DataFrame, ids: list[str], level: int | None) -> DataFrame:
    """A level of their own for some files, or none (null)."""
    return files.withColumn("intensity", F.when(F.col("file_id").isin(ids), F.lit(level).cast("int")).otherwise(F.col("intensity")))


def location_keys(pairs: DataFrame) -> DataFrame:
    """(file_id, page_num, half, start) of every half: what stays the same when a page is scanned again. Of located
    coordinates it is the first segment of each half, which may lie on another page."""
    if "lat_segs" in pairs.columns:
        both = F.array(*(F.struct(F.lit(h).alias("half"), F.get(f"{h}_segs", F.lit(0)).alias("at")) for h in ("lat", "lon")))
        return pairs.select("file_id", F.inline(both)).where("at is not null").select("file_id", "at.page_num", "half", "at.start")
    return halves(pairs).select(*LOC_KEY)
