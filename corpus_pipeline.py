"""The corpus pipeline: five stages that take the documents one after another.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns
of ``documents``; the last returns the mix, which holds a document once per epoch.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resultloom.llm import lines, mixing, simhash, tiling, toxicity
from resultloom.runtime import materialize

# Bytes of rows handed to Python at once. Texts of documents make batches counted in rows tens of MB wide, of
# which a task holds several, within and outside the JVM; this bounds them, not what is read.
BATCH_BYTES = 4 << 20


def in_small_batches(stage):
    """``stage`` with batches for Python bounded by bytes in its session, also when its result is computed later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold.

    The classifier is fitted on the labelled ones of ``docs``, but for those held out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out("doc_id", 4))
    scored = toxicity.score(docs, toxicity.train(docs, labels), "_toxicity")
    return scored.filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


@in_small_batches
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand before; those of such lines only go."""
    return lines.clean_lines(docs, least_equal=1)


@in_small_batches
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints."""
    return simhash.one_of_each(docs)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, once per epoch."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

# Hashed classifier features, edit distances and tilings have no SQL form: the tests hold the
# stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
