"""The operators bound to the given tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resultloom.llm import lm, toxicity
from resultloom.llm.exact import mark_copies
from resultloom.llm.html import extract
from resultloom.llm.lines import dedup_lines
from resultloom.llm.mixing import mix
from resultloom.llm.negatives import hard_negatives
from resultloom.llm.simhash import near_duplicates
from resultloom.llm.substrings import dedup_substrings
from resultloom.llm.suffixes import dedup_bytes
from resultloom.llm.tiling import contamination
from resultloom.llm.vptree import nearest
from resultloom.llm.whitening import whiten


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = lm.train(docs.filter(~toxicity.held_out("doc_id", 7)))
    return lm.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).drop("copies")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_substrings(table(spark, folder, "documents"), digest=True)
    return done.drop("spans").withColumnRenamed("kept", "kept_sha256")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out("doc_id", 4)))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", toxicity.held_out("doc_id", 4).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_bytes(table(spark, folder, "documents"), digest=True)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_lines(table(spark, folder, "documents"), least_equal=1)
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return mark_copies(table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_nearest": op7_nearest,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_html": op10_html,
    "op11_whitening": op11_whitening,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
