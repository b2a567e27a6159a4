"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names. Only where that is not set and the
    master is local, as in tests, it is a temporary one; a cluster without it is refused."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="waymark-"))
    return sc.getCheckpointDir()


def unique() -> str:
    return uuid.uuid4().hex


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The table written to the shared folder and read again: what several passes read is computed once, and a
    lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{unique()}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "num") -> DataFrame:
    """``df`` with ``name``, its rows' places from 1 on in the order of the columns ``order``.

    Rows are sorted in ranges and written once; a row's place in its range is counted by Spark, and only one size
    of each range reaches the driver. No task sees more than its range.
    """
    at = F.monotonically_increasing_id()
    low = (1 << 33) - 1
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "numbered")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(low))
    sizes = placed.groupBy(part.alias("part")).agg(F.max(within).alias("last")).orderBy("part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["last"] + 1
    base = df.sparkSession.createDataFrame(pa.table({"__part": pa.array([p for p, _ in offsets], pa.int64()), "__base": pa.array([b for _, b in offsets], pa.int64())}))
    # One row for each range, so the table that goes to all tasks is as small as the number of ranges.
    both = placed.withColumn("__part", part).join(F.broadcast(base), "__part")
    return both.withColumn(name, (F.col("__base") + within + 1).cast("long")).drop("__at", "__part", "__base")
