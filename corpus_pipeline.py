"""A corpus pipeline over documents: language, quality, near copies, repeated passages, packing.

Each stage takes and, but for the last, returns documents (doc_id, text, lang, source, n_chars); other columns are ignored. An
empty table gives an empty result. A null id is a document of its own, which no other can stand for; rows that repeat an
id stay or go together; a null text counts as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import langid, quality
from waymark.llm.common import table
from waymark.llm.neardup import near_duplicates
from waymark.llm.queries import pack_documents
from waymark.llm.substring import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if no language fits it: no letters, or the best language has less than this share of its words.
LEAST_LANGUAGE = 0.35
LEAST_QUALITY = 0.3


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined. Null and empty texts and texts without letters go."""
    docs = _columns(docs)
    said = langid.identify(docs, langid.train(docs), lang="__lang", score="__share")
    return said.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__share") >= LEAST_LANGUAGE)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good, as fitted on the labels of the documents given. Without labels its scores are
    those of an unlearned model, about a half, so all stay."""
    docs = _columns(docs)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), name="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id; null ids and texts without words stay."""
    docs = _columns(docs)
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur more than once. Unchanged texts stay as they
    are; documents that lose all their words go; n_chars follows the text."""
    docs = _columns(docs)
    out = substring_dedup(docs, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return out.where(~changed | (F.col("kept_text") != "")).select(
        "doc_id",
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in windows of 1024."""
    return pack_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Trained models are not SQL; tests hold every stage's rows against brute force, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    from waymark.llm.common import shared_folder

    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
