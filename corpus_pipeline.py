"""From raw documents to token ids: five stages, each an operator of gapwise.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the
next one. All but the last return the columns of ``documents``. No stage collects or broadcasts anything that grows
with the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import bpe, decontaminate, overlap, pii, quality
from gapwise.llm.common import table
from gapwise.session import write_stage

#: The stages train and walk models and automata, which SQL does not express; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None

#: Bytes of rows that go to Python at once, unless the session names its own. At Spark's 64 MB a batch holds 10,000 texts, and each
#: running task has it several times: as a direct buffer, as Arrow vectors that double while they grow, and in the worker.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, in a session whose batches of texts are small."""
    @wraps(stage)
    def started(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_KEY, spark.conf.get(BATCH_KEY, BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return started


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling rejects go."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word similarity of 0.8 stays, the one with the smallest doc_id.

    SimHash fingerprints and their deletion variants link first, a join of the shingle sets' sketches finds what they miss.
    """
    return overlap.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in a text is replaced by its kind; every document stays."""
    return pii.redact(docs, pii.learn(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them, per document."""
    return bpe.tokenize(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [(name, small_batches(stage)) for name, stage in [
    ("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination),
    ("personal data", personal_data), ("encoding", encode)]]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), name.replace(" ", "-")).frame
    return docs
