"""What happens once a search is complete: link duplicates, rank, store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.operators.dedup import annotate, dedup_stats
from resultloom.operators.ranking import rank_results, with_overlap
from resultloom.operators.skew import TASK_ROWS
from resultloom.operators.views import search_status
from resultloom.plans.evaluation import ambiguous_pairs
from resultloom.plans.operations import search_timings


def finish(
    results: DataFrame, searches: DataFrame, now: datetime | str, *, task_rows: int = TASK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(annotated and ranked rows without texts, duplicate groups) of the given searches.

    The one pass over the texts finds relevance and linking keys together.
    """
    annotated, groups = annotate(with_overlap(results, searches))
    ranked = rank_results(annotated, searches, now, task_rows=task_rows)
    columns = [*annotated.columns, "relevance", "freshness", "quality", "rank_score", "rank_position"]
    return ranked.select(*columns), groups


def search_stats(searches: DataFrame, events: DataFrame, groups: DataFrame, ranked: DataFrame) -> DataFrame:
    """Status, dedup and ranking numbers of each search, and where its time went.

    ``total_ms`` runs from creation to completion, null while the search runs; ``postpass_ms``
    is what is left of it once the slowest source has answered.
    """
    counts = ranked.groupBy("search_id").agg(F.count("rank_position").alias("ranked"))
    total = (F.unix_micros("completed_at") - F.unix_micros("created_at")) / 1000.0
    return (
        dedup_stats(groups, searches)
        .join(searches.select("search_id", total.alias("total_ms")), "search_id")
        .join(search_status(events), "search_id", "left")
        .join(search_timings(events).drop("sources"), "search_id", "left")
        .join(counts, "search_id", "left")
        .withColumn("postpass_ms", F.when(F.col("total_ms").isNotNull(), F.greatest(F.lit(0.0), F.col("total_ms") - F.coalesce("sources_ms", F.lit(0)))))
        .na.fill(0, ["ranked", "failed", "sources"])
        .na.fill("completed", ["status"])
    )


def annotation_report(
    results: DataFrame, annotated: DataFrame, groups: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Whether stored annotations hold together: rows kept, sizes, roles, unclear pairs merged."""
    before = results.agg(F.count("*").alias("rows_in"))
    after = annotated.agg(
        F.count("*").alias("rows_out"), F.count_if("is_duplicate").alias("duplicates")
    )
    sizes = annotated.filter(F.col("duplicate_group_id").isNotNull()).groupBy("duplicate_group_id").agg(
        F.count("*").alias("members"),
        F.count_if(~F.col("is_duplicate")).alias("canonicals"),
        F.min(F.when(~F.col("is_duplicate"), F.col("id"))).alias("shown"),
    )
    checked = groups.join(sizes, groups["group_id"] == sizes["duplicate_group_id"], "left").agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum(F.col("member_count") - 1), F.lit(0)).alias("stated_duplicates"),
        F.count_if(F.col("members") == F.col("member_count")).alias("sizes_right"),
        F.count_if((F.col("canonicals") == 1) & (F.col("shown") == F.col("canonical_id"))).alias(
            "canonicals_right"
        ),
    )
    labels = annotated.select(
        "search_id", "id", F.col("duplicate_group_id").alias("gold"), F.col("duplicate_group_id").alias("found")
    )
    merged = ambiguous_pairs(labels, pairs, ["found"]).agg(
        F.count_if("in_predicted").alias("ambiguous_merged")
    )
    told = None
    for part in (before, after, checked, merged):
        facts = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("n")) for c in part.columns])
        rows = part.select(F.explode(facts).alias("f")).select("f.*")
        told = rows if told is None else told.unionByName(rows)
    names = [c for part in (before, after, checked, merged) for c in part.columns]
    report = told.agg(*[F.max(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in names])
    return report.withColumn("rows_preserved", F.col("rows_in") == F.col("rows_out"))
