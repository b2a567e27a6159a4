"""Scanning newly arrived page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import DEFAULT_LEVEL
from ..operators.extract import PAIRS, build_detections, drop_suppressed, first_places, fresh_rows, located, merge_cross_page, pairs_over_breaks, read_pages
from ..sources.shared import written

PAGES = "file_id string, page_num int, text string"
_fields = lambda *named: T.StructType([T.StructField(n, T.StringType() if n in ("file_id", "head", "tail") else T.IntegerType()) for n in named])
ENDS = _fields("file_id", "page_num", "head", "tail", "tail_start", "size", "head_bits", "tail_bits")
HELD = _fields("file_id", "at", "start", "end")


class FileState:
    """What a stream remembers of each file, as tables under ``base``: the ends of its last page, the pairs on it, and the
    places there that cross pairs have. Each batch writes the state of its own files into a partition of its own and reads
    only those of earlier batches, so a repeated batch sees what it saw before."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _read(self, name: str, schema: T.StructType, batch_id: int, some: DataFrame) -> DataFrame:
        own = T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])
        return self.spark.read.schema(own).parquet(f"{self.base}/{name}").where(F.col("batch_id") < batch_id).join(some, "file_id", "left_semi")

    def before(self, batch_id: int, some: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """(ends, pairs, held places) of the files ``some`` (file_id) as the latest earlier batch with each left them."""
        if batch_id == 0:
            return None
        ends = self._read("ends", ENDS, batch_id, some)
        latest = written(ends.groupBy("file_id").agg(F.max("batch_id").alias("batch_id")), "latest")
        own = lambda t: t.join(latest, ["file_id", "batch_id"], "left_semi").drop("batch_id")
        return own(ends), own(self._read("pairs", PAIRS, batch_id, some)), own(self._read("held", HELD, batch_id, some))

    def after(self, batch_id: int, ends: DataFrame, pairs: DataFrame, cross: DataFrame) -> None:
        last = written(ends.groupBy("file_id").agg(F.max("page_num").alias("page_num")), "last-pages")
        places = first_places(cross).select("file_id", "at", "start", "end").join(last.withColumnRenamed("page_num", "at"), ["file_id", "at"], "left_semi")
        for name, table in (("ends", ends.join(last, ["file_id", "page_num"], "left_semi")), ("pairs", pairs.join(last, ["file_id", "page_num"], "left_semi")), ("held", places)):
            _replace(table, f"{self.base}/{name}", batch_id)


def _replace(table: DataFrame, path: str, batch_id: int) -> None:
    table.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def scan_stream(spark: SparkSession, in_dir: str, out: str, checkpoint: str, suppressed: DataFrame, level: int = DEFAULT_LEVEL, n_cols: int = 2) -> StreamingQuery:
    """Scan Parquet files of pages (file_id, page_num, text) as they arrive and write the rows and detections of each
    batch to ``out``/rows and ``out``/dets; ``stream_tables`` reads them. Stops when all that is there has been read.

    The pages of a file may come in any number of batches, in order of their numbers. What lies across two batches is found with
    the state of the file: a cross pair takes over the lone halves of the page that came before, whose rows are then listed in ``out``/gone. Each
    batch replaces its own partition, so a repeated batch leaves no doubles. All batches together give the rows of one.
    """
    state = FileState(spark, f"{out}/state")

    def scan(batch: DataFrame, batch_id: int) -> None:
        own, ends = read_pages(batch, None, level)
        own = drop_suppressed(own, suppressed)
        some = written(ends.select("file_id").distinct(), "files")
        before = state.before(batch_id, some)
        pairs, held, old = own, None, None
        if before is not None:
            old_ends, old, held = before
            ends, pairs = ends.unionByName(old_ends), own.unionByName(old)
        cross = written(pairs_over_breaks(ends, None, level), "cross-pairs")
        merged, accepted = merge_cross_page(pairs, cross, suppressed, held)
        merged, accepted = written(merged, "merged"), written(accepted, "accepted")
        key = ["file_id", "page_num", "pair_idx"]
        row_id = F.concat_ws(":", "file_id", "page_num", F.lit(0), "pair_idx").alias("row_id")
        gone = (own.limit(0) if old is None else old.join(merged, key, "left_anti")).select(row_id)
        fresh = merged if old is None else merged.join(old, key, "left_anti")
        coords = written(located(fresh, accepted), "coordinates")
        for name, table in (("rows", fresh_rows(coords, n_cols)), ("dets", build_detections(coords)), ("gone", gone)):
            _replace(table, f"{out}/{name}", batch_id)
        state.after(batch_id, ends, merged, accepted)

    pages = spark.readStream.schema(PAGES).parquet(in_dir)
    return pages.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_tables(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(rows, detections) of all batches of a stream, without what later batches took over."""
    gone = spark.read.parquet(f"{out}/gone").select("row_id")
    rows, dets = (spark.read.parquet(f"{out}/{name}").join(gone, "row_id", "left_anti") for name in ("rows", "dets"))
    return rows, dets
