"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.  All but the last keep the columns of documents.
Rows without a doc_id pass the near-duplicate stage as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm import minhash, packing, quality, secrets, substring_dedup
from lattica.llm.common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Bytes of an Arrow batch between Spark and its Python workers; whole texts fill Spark's own 64 MB, several times a task on both sides.
BATCH_BYTES = 8 << 20


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` under the session's batch size of ``BATCH_BYTES``, which stays set as its result runs later; a smaller one is kept."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        now = str(spark.conf.get(key, None) or "").removesuffix("b")
        if not (now.isdigit() and int(now) <= BATCH_BYTES):
            spark.conf.set(key, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


@_in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score under 0.5) go."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), "quality")
    return quality.with_scores(docs, model, "text", "_score").where("_score >= 0.5").select(*COLUMNS)


@_in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; of equal rows one."""
    named = docs.where("doc_id is not null")
    found = durable(minhash.near_duplicates(named.select("doc_id", "text")).select("doc_id", "kept"))
    kept = named.join(found.where("kept").select("doc_id").distinct(), "doc_id", "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        by = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
        kept = kept.withColumn("_n", F.row_number().over(by)).where("_n = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


@_in_small_batches
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentence spans that an earlier document holds are removed from the texts."""
    return _measured(substring_dedup.dedup(docs))


@_in_small_batches
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return _measured(secrets.with_masks(docs))


@_in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their identifiers."""
    pieces = packing.pack(docs, end_id=1, most=2048)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the vocabulary; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
