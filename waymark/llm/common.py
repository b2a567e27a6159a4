"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text) of a documents table; a null text becomes the empty text."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names.

    Only where none is set and the master is local, as in tests, it is a temporary folder; a cluster
    without one is refused.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="waymark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose text column holds about ``limit`` bytes at most.

    One text longer than the limit is a block of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(total):
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def crc_mod(id_col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % mod, F.lit(-1))


def share(total: int, size: int) -> int:
    """Number of groups that keeps each at about ``size`` rows."""
    return max(1, -(-total // size))


def append(docs: DataFrame, columns: dict[str, pa.DataType], compute, text_col: str = "text", limit: int = 1 << 20) -> DataFrame:
    """``docs`` with columns that ``compute(texts)`` returns as Arrow arrays; nulls count as empty texts.

    The names of ``columns`` must be new to ``docs``. No shuffle.
    """
    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*docs.schema.fields, *(StructField(n, from_arrow_type(t)) for n, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col, limit):
            made = compute(pc.fill_null(block.column(text_col), ""))
            yield pa.RecordBatch.from_arrays([*block.columns, *made], names=[*block.schema.names, *columns])

    return docs.mapInArrow(run, schema)
