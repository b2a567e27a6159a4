"""Scans that take over earlier readings.

What is found in a text depends on the text and the level alone, so it is stored by the text's digest and the level. A later
scan reads only texts that are new, have changed or come at another level; all else is looked up. Every stored row
holds by itself, so a write that stopped halfway leaves a store that is right, and readings stored twice count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import tokens as tk
from ..sources.shared import written
from .extract import PAIRS, break_texts, in_both_pages, leveled, merged_coordinates, page_ends, with_segments

KEY = ["digest", "level"]
FOUND = T.ArrayType(T.StructType(PAIRS.fields[2:]))
STORED = T.StructType([T.StructField("digest", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("pairs", FOUND)])
_READ = T.StructType([*PAIRS.fields[:2], *STORED.fields])


def digest(text: Column | str = "text") -> Column:
    """What a text is stored by; null for a text without a digit, in which nothing is found."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.regexp_like(c, F.lit("[0-9]")), F.sha2(c, 256))


def stored_keys(spark: SparkSession, base: str) -> DataFrame:
    """(digest, level) of all readings of a store."""
    return _store(spark, base).select(*KEY).distinct()


def _store(spark: SparkSession, base: str) -> DataFrame:
    spark.createDataFrame([], STORED).write.mode("ignore").parquet(f"{base}/readings")
    return spark.read.schema(STORED).parquet(f"{base}/readings")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_READ)
    for batch in batches:
        found = []
        for text, level in zip(batch.column("text").to_pylist(), batch.column("level").to_pylist(), strict=True):
            pairs = enumerate(tk.extract(text, level))
            found.append([{"pair_idx": i, "lat": lat and lat._asdict(), "lon": lon and lon._asdict()} for i, (lat, lon) in pairs])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _READ.names[:4]), pa.array(found, schema.field("pairs").type)], schema=schema)


def stored_pairs(keyed: DataFrame, texts: DataFrame, base: str) -> DataFrame:
    """``keyed`` (file_id, page_num, digest, level, ...) without digest and level, but with pair_idx, lat and lon of the pairs in its
    texts, which are ``texts`` (file_id, page_num, text, level).

    Of texts that the store lacks, one copy of each is stored. If these are the lesser part, they are picked
    before they are read; else all texts are read where they lie, so that they are not shuffled. Both store the same.
    """
    spark, whole = keyed.sparkSession, ["file_id", "page_num", *KEY]
    wanted = keyed.where("digest is not null")
    one = wanted.groupBy(*KEY).agg(F.min(F.struct("file_id", "page_num")).alias("at"))
    lacking = written(one.join(_store(spark, base).select(*KEY), KEY, "left_anti").select("at.*", *KEY), "lacking")
    n = lacking.count()
    if n:
        own = texts.withColumn("digest", digest()).where("digest is not null").select(*whole, "text")
        if 2 * n < wanted.count():
            found = own.join(lacking, whole, "left_semi").mapInArrow(_read, _READ)
        else:
            found = own.mapInArrow(_read, _READ).join(lacking, whole, "left_semi")
        found.select(*STORED.names).write.mode("append").parquet(f"{base}/readings")
    known = _store(spark, base).join(wanted.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
    both = wanted.join(written(known, "known"), KEY)
    return both.select(*(c for c in keyed.columns if c not in KEY), F.inline("pairs"))


def scan_by_store(pages: DataFrame, files: DataFrame, suppressed: DataFrame, base: str, level: int = tk.DEFAULT_LEVEL) -> DataFrame:
    """The coordinates of ``scan_coordinates``, with the readings of the store in the folder ``base``, which takes up those
    that it lacks. Texts around page breaks are stored likewise."""
    all_ = leveled(pages, files, level).select("file_id", F.col("page_num").cast("int"), "text", "level")
    read = written(page_ends(all_.withColumn("digest", digest()), keep=("digest", "level")), "ends")
    own = written(stored_pairs(read.select("file_id", "page_num", *KEY), all_, base), "pairs")
    joint = written(break_texts(read.drop(*KEY), files, level).withColumn("digest", digest()), "breaks")
    over = stored_pairs(joint.drop("text"), joint.select("file_id", "page_num", "text", "level"), base).where(in_both_pages())
    return merged_coordinates(own, written(with_segments(over), "cross-pairs"), suppressed)
