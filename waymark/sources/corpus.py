"""Listing a folder of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import FolderSource
from .shared import numbered

SCHEMA = "file_id string, file_seq long, name string, path string, error string, num_pages int, intensity int, hidden boolean"


def natural_key(c: Column, width: int = 20) -> Column:
    """A text whose digit runs are padded, so that it sorts by number; case does not matter."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]+$")) & (F.length(p) < width), F.lpad(p, width, "0")).otherwise(p))
    return F.array_join(padded, "")


def files_of(paths: DataFrame, root: str, max_depth: int | None = 4, max_files: int | None = 500) -> DataFrame:
    """Files table of paths (path): *.pdf in any case, no part of the path below ``root`` begins with a dot, at most
    ``max_depth`` folders deep, in natural order of folders and names, at most ``max_files``. Any number of
    paths is ordered in ranges."""
    base = root.rstrip("/")
    rest = F.when(F.col("path").startswith(base + "/"), F.expr(f"substring(path, {len(base) + 2})")).otherwise(F.col("path"))
    parts = F.split(rest, "/")
    some = paths.select("path", parts.alias("parts")).where(F.lower(F.element_at("parts", -1)).endswith(".pdf"))
    some = some.where(~F.exists("parts", lambda p: p.startswith(".")))
    if max_depth is not None:
        some = some.where(F.size("parts") - 1 <= max_depth)
    keyed = some.withColumn("key", F.transform("parts", lambda p: natural_key(p)))
    if max_files is not None:
        keyed = keyed.orderBy("key", "path").limit(max_files)
    none = F.lit(None)
    return numbered(keyed, "key", "path", name="file_seq").select(
        F.concat(F.lit("f"), "file_seq").alias("file_id"), "file_seq", F.element_at("parts", -1).alias("name"), "path",
        none.cast("string").alias("error"), none.cast("int").alias("num_pages"), none.cast("int").alias("intensity"), F.lit(False).alias("hidden"),
    )


def list_corpus(spark: SparkSession, root: str, max_depth: int | None = 4, max_files: int | None = 500) -> DataFrame:
    """Files table of a folder. Only names are read, no contents.

    A mounted folder is walked level by level on the executors: folders below the depth and those that begin with a dot are never
    opened. In a store that only Spark reads (``scheme://``), Spark's own listing is used, which passes over names that begin with
    ``_``.
    """
    if root.startswith("file:") or "://" not in root:
        root = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
        spark.dataSource.register(FolderSource)
        walk = spark.read.format("waymark_folder").option("path", root)
        found = (walk if max_depth is None else walk.option("depth", max_depth)).load()
        return files_of(found, root, max_depth, max_files)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files_of(found.select("path"), root, max_depth, max_files)
