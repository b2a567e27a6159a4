"""Counts over files, pages, rows and review runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import visible_rows

VERDICTS = ("ok", "mismatch", "not_found")


def file_summary(files: DataFrame, dets: DataFrame) -> DataFrame:
    """(file_id, name, num_pages, error, n_dets) of every file, 0 for none."""
    found = dets.groupBy("file_id").agg(F.count("*").alias("n"))
    return files.join(found, "file_id", "left").select("file_id", "name", "num_pages", "error", F.coalesce("n", F.lit(0)).alias("n_dets"))


def corpus_summary(files: DataFrame, dets: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: n_files, n_hidden, n_pages with detections in visible files, n_rows visible."""
    shown = files.where("not hidden").select("file_id")
    pages = dets.join(shown, "file_id", "left_semi").select("file_id", "page_num").distinct()
    counted = [
        files.agg(F.count("*").alias("n_files"), F.count_if("hidden").alias("n_hidden")),
        pages.agg(F.count("*").alias("n_pages")),
        visible_rows(rows, files).agg(F.count("*").alias("n_rows")),
    ]
    every = counted[0].unionByName(counted[1], allowMissingColumns=True).unionByName(counted[2], allowMissingColumns=True)
    return every.agg(*(F.sum(c).alias(c) for c in every.columns))


def pages_with_hits(pages: DataFrame, dets: DataFrame, show_all: bool = False) -> DataFrame:
    """(file_id, page_num, n_dets) of pages with detections, or of all pages."""
    found = dets.groupBy("file_id", "page_num").agg(F.count("*").alias("n"))
    own = pages.select("file_id", F.col("page_num").cast("int"))
    return own.join(found, ["file_id", "page_num"], "left" if show_all else "inner").select("file_id", "page_num", F.coalesce("n", F.lit(0)).alias("n_dets"))


def sent_summary(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_id, n_rows, n_sent) of visible files without error."""
    counts = rows.groupBy("file_id").agg(F.count("*").alias("n"), F.count("llm_sent").alias("s"))
    some = files.where("error is null and not hidden").select("file_id")
    return some.join(counts, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("s", F.lit(0)).alias("n_sent"))


def run_summary(events: DataFrame) -> DataFrame:
    """One row of counts from a run's events (row_id, kind): verdicts, filled, noted, flagged, deleted,
    confirm_kept, retried, retry_fixed, unbadged, skipped."""
    kinds = (*VERDICTS, "filled", "noted", "flagged", "deleted", "confirm_kept", "retried", "retry_fixed", "unbadged", "skipped")
    return events.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))


def deletion_report(deleted: DataFrame, limit: int = 15) -> DataFrame:
    """(place, line): the first ``limit`` deleted rows (num, lat, lon, file, page, note), then how many more."""
    or_ = lambda c, t: F.coalesce(F.col(c).cast("string"), F.lit(t))
    reason = F.coalesce(F.nullif("note", F.lit("")), F.lit("no reason given"))
    line = F.concat(
        F.lit("#"), F.col("num"), F.lit(" — "), or_("lat", "(no lat)"), F.lit(", "), or_("lon", "(no lon)"), F.lit(" ("), F.col("file"), F.lit(" p."), F.col("page"), F.lit("): "), reason
    )
    first = deleted.select(F.col("num").cast("long").alias("place"), line.alias("line")).orderBy("place", "line").limit(limit)
    more = deleted.agg((F.count("*") - limit).alias("n")).where("n > 0")
    return first.union(more.select(F.lit(None).cast("long").alias("place"), F.concat(F.lit("… and "), F.col("n").cast("string"), F.lit(" more")).alias("line")))
