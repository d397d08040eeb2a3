"""A corpus from raw documents: known language, no exact and near copies, sources mixed, encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.llm.common import load, lower_ascii, row_hash, stored, text_or_empty, unused
from profileloom.llm.exact_dedup import exact_duplicates
from profileloom.llm.language_id import with_known_language
from profileloom.llm.mixture import mixed_texts
from profileloom.llm.queries import MODEL_PATH
from profileloom.llm.sentencepiece_codec import encode_documents
from profileloom.llm.simhash import first_of_near_copies

#: Rows of an Arrow batch while texts go to Python. An executor holds a batch several times over for each of its tasks.
TEXTS_AT_ONCE = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Removes the shuffle files of a query when it ends. Else they stay until the driver collects its garbage, which a large heap may never do in a stage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _settings(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to TEXTS_AT_ONCE rows, unless they are smaller (Spark takes zero and less as no limit), and _SHUFFLES_GO.

    The settings outlast the stage, since what a stage returns runs later. No result depends on them.
    """
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= TEXTS_AT_ONCE:
        spark.conf.set(_ARROW_ROWS, str(TEXTS_AT_ONCE))
    spark.conf.set(_SHUFFLES_GO, "true")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs for each row of kept (doc_id, text_sha256 as of exact_duplicates), which are distinct.

    Of several rows with one doc_id and text, one is taken; ranking drops the others before the shuffle. Ranks and the join deal
    rows out by the same columns, none of them null, so texts are shuffled once.
    """
    doc, null, key, rank = unused(docs, "doc", "null", "key", "rank")
    known = lambda c: (F.coalesce(c.cast("long"), F.lit(0).cast("long")), c.isNull())
    kept = kept.select(*(c.alias(n) for c, n in zip((*known(F.col("doc_id")), F.col("text_sha256")), (doc, null, key), strict=True)))
    value, is_null = known(F.col("doc_id"))
    rows = docs.withColumns({doc: value, null: is_null, key: F.sha2(lower_ascii(text_or_empty("text")), 256)})
    first = F.row_number().over(W.partitionBy(doc, null, key).orderBy(row_hash(docs)))
    rows = rows.withColumn(rank, first).where(F.col(rank) == 1)
    return rows.join(kept, [doc, null, key], "left_semi").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language can be told, with that language as lang; null and empty texts and those without letters go."""
    _settings(spark)
    return with_known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text, that of the largest doc_id; of repeated rows one stays, a null id only where no row has another."""
    _settings(spark)
    return _only(docs, exact_duplicates(docs).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts of 5-word Jaccard similarity 0.8, that of the smallest doc_id; ids and repeats as in exact_stage."""
    _settings(spark)
    return _only(docs, first_of_near_copies(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each round that takes words of a document, with those words; texts without words aren't in it."""
    _settings(spark)
    return mixed_texts(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row; null text counts as empty, repeated rows are repeated."""
    _settings(spark)
    return encode_documents(docs, MODEL_PATH)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Language identification and encoding can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
