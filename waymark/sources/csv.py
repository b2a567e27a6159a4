"""Export of the table as CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cell, cell_text, coord_columns, csv_escape
from ..operators.rows import visible_rows

BOM = "﻿"


def csv_header(cols: list[str], fmt: str, notes_on: bool) -> list[str]:
    return [*cols, *(label for _, _, label in coord_columns(fmt)), *(["Notes"] if notes_on else [])]


def csv_line(cols: list[str], fmt: str, notes_on: bool) -> Column:
    """One row as a CSV line, without its line end."""
    parts = [cell(i) for i in range(len(cols))] + [cell_text(f, m, fmt) for f, m, _ in coord_columns(fmt)]
    if notes_on:
        parts.append(F.coalesce("notes", F.lit("")))
    return F.concat_ws(",", *(csv_escape(p) for p in parts))


def csv_lines(rows: DataFrame, files: DataFrame, cols: list[str], fmt: str = "dd", notes_on: bool = False) -> DataFrame:
    """(row_seq, value) of the visible rows."""
    return visible_rows(rows, files).select("row_seq", csv_line(cols, fmt, notes_on).alias("value"))


def export_csv(rows: DataFrame, files: DataFrame, cols: list[str], path: str, fmt: str = "dd", notes_on: bool = False, single_file: bool = False) -> None:
    """Write the visible rows in order: byte order mark, header, CRLF line ends. The parts in order of name are the
    file; with ``single_file`` they are written as one (by one task)."""
    spark = rows.sparkSession
    head = ",".join('"' + h.replace('"', '""') + '"' if any(c in h for c in '",\n\r') else h for h in csv_header(cols, fmt, notes_on))
    first = spark.range(1).select(F.lit(None).cast("struct<kept:int,file_seq:long,scan_page:int,is_cross:int,pair_idx:long>").alias("row_seq"), F.lit(BOM + head).alias("value"))
    ordered = first.union(csv_lines(rows, files, cols, fmt, notes_on)).orderBy(F.col("row_seq").asc_nulls_first())
    out = (ordered.coalesce(1) if single_file else ordered).select("value")
    out.write.mode("overwrite").option("lineSep", "\r\n").text(path)
