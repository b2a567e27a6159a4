"""Projects: tables of one user's work, stored by project.

Each save notes in the manifest that it has begun, writes its tables into a folder of its own, then appends one more row to the
manifest, which makes that folder the current one. The row is one file, and it comes last, so a save that fails halfway changes
nothing; the latest row of a project, but for those of begun saves, says what it is.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import padded_cells

TABLES = ("files", "rows", "dets", "suppressed")
MANIFEST = "project_id string, version string, seq long, state string, saved_at timestamp, name string, cols array<string>, fmt string, level int"


def _log(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def _latest(spark: SparkSession, base: str) -> DataFrame:
    """The latest row of each project that is not deleted."""
    rows = _log(spark, base).where("state <> 'begun'").groupBy("project_id").agg(F.max_by(F.struct("version", "state", "saved_at", "name", "cols", "fmt", "level"), F.struct("seq", "version")).alias("at"))
    return rows.where("at.state = 'saved'").select("project_id", "at.*")


def _append(spark: SparkSession, base: str, project_id: str, version: str, state: str, name: str | None = None, cols: list[str] | None = None, fmt: str = "dd", level: int = 5) -> None:
    """One row, in one file, that the commit moves into its place."""
    row = spark.range(1).select(
        F.lit(project_id).alias("project_id"), F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("seq"), F.lit(state).alias("state"),
        F.current_timestamp().alias("saved_at"), F.lit(name).cast("string").alias("name"), (F.lit(cols) if cols else F.array()).cast("array<string>").alias("cols"),
        F.lit(fmt).alias("fmt"), F.lit(level).cast("int").alias("level"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{base}/manifest")


def save_project(tables: dict[str, DataFrame], base: str, project_id: str, name: str, cols: list[str], fmt: str = "dd", level: int = 5) -> None:
    """Write a project's tables and then make them its current ones. They may be read from the project itself."""
    version = uuid.uuid4().hex
    spark = tables["files"].sparkSession
    _append(spark, base, project_id, version, "begun")
    for table in TABLES:
        tables[table].write.parquet(f"{base}/versions/{version}/{table}")
    _append(spark, base, project_id, version, "saved", name, cols, fmt, level)


def load_project(spark: SparkSession, base: str, project_id: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, settings). Absent fields get their defaults; cells are filled up or cut to the columns."""
    saved = _latest(spark, base).where(F.col("project_id") == project_id).first()
    if saved is None:
        raise KeyError(project_id)
    settings = {"name": saved["name"], "cols": saved["cols"] or ["Genus", "Species"], "fmt": saved["fmt"] or "dd", "level": saved["level"] or 5}
    tables = {t: spark.read.parquet(f"{base}/versions/{saved['version']}/{t}") for t in TABLES}
    tables["rows"] = tables["rows"].withColumn("cells", padded_cells(len(settings["cols"]))).withColumn("notes", F.coalesce("notes", F.lit("")))
    tables["files"] = tables["files"].withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    return tables, settings


def list_projects(spark: SparkSession, base: str) -> DataFrame:
    """(project_id, name, saved_at), latest first."""
    return _latest(spark, base).select("project_id", "name", "saved_at").orderBy(F.desc("saved_at"), "project_id")


def _empty(spark: SparkSession, base: str, versions: list[str]) -> None:
    """Replace the tables of versions by empty ones, so that their data are gone."""
    for version in versions:
        for table in TABLES:
            path = f"{base}/versions/{version}/{table}"
            try:
                schema = spark.read.parquet(path).schema
            except AnalysisException:  # the save failed before it came to this table
                continue
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def _versions(spark: SparkSession, base: str, project_id: str) -> list[str]:
    """All versions of a project, those of failed saves included, as they were begun: a few strings."""
    rows = _log(spark, base).where((F.col("project_id") == project_id) & (F.col("state") == "begun")).orderBy("seq", "version").select("version").collect()
    return [r["version"] for r in rows]


def delete_project(spark: SparkSession, base: str, project_id: str) -> None:
    """Take a project off the list, then empty the tables of all its versions."""
    versions = _versions(spark, base, project_id)
    _append(spark, base, project_id, "", "deleted")
    _empty(spark, base, versions)


def drop_old_versions(spark: SparkSession, base: str, project_id: str) -> None:
    """Empty the tables of all versions that were begun before the current one."""
    current = _latest(spark, base).where(F.col("project_id") == project_id).first()["version"]
    versions = _versions(spark, base, project_id)
    _empty(spark, base, versions[: versions.index(current)])
