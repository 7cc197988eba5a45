"""Where records, events and reports are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.operators.views import check_page
from resultloom.sources.payloads import DEADLINE_MS, SOURCE_NAMES, with_outcome


def bucket_of(search_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(search_id), F.lit(buckets)).cast("int")


def read_searches(store: DataFrame, search_ids: DataFrame, buckets: int) -> DataFrame:
    """Stored rows of some searches; only their buckets are read."""
    wanted = search_ids.select("search_id", bucket_of(F.col("search_id"), buckets).alias("bucket")).distinct()
    return store.join(wanted, ["bucket", "search_id"], "left_semi")


def append_results(results: DataFrame, path: str, buckets: int = 512) -> None:
    """Append records, laid out by a hash of the search so that one search reads few files.

    The bucket column is a partition column. Rows are gathered by bucket before the write, small
    buckets in one task and a large one over several, so that files are few and of bounded size.
    """
    bucketed = results.withColumn("bucket", bucket_of(F.col("search_id"), buckets))
    bucketed.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def store_ranked(ranked: DataFrame, path: str, buckets: int = 512) -> None:
    """Write the ranked rows of finished searches as ``append_results`` does, in order of search and place.

    A page of a search is then a range of places, and the row groups of a file tell which hold it.
    """
    bucketed = ranked.withColumn("bucket", bucket_of(F.col("search_id"), buckets)).hint("rebalance", "bucket")
    bucketed.sortWithinPartitions("bucket", "search_id", "rank_position").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def stored_pages(store: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """The given page of every finished search in a store of ``store_ranked``, with its place in the view.

    Places have no gaps, so a page is a range of them: a filter of the scan, without sort or shuffle.
    """
    check_page(page, per_page)
    start = (page - 1) * per_page
    return store.filter(F.col("rank_position").between(start, start + per_page - 1)).withColumn(
        "view_position", F.col("rank_position") + 1
    )


def stored_page_of(store: DataFrame, search_id: str, buckets: int, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of one finished search: of one bucket, the row groups that hold its places."""
    rows = store.filter((F.col("bucket") == bucket_of(F.lit(search_id), buckets)) & (F.col("search_id") == search_id))
    return stored_pages(rows, page, per_page)


def source_events(landing: DataFrame, results: DataFrame, deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """One event per (search, source): outcome, record count, latency, message."""
    names = F.create_map(*[F.lit(x) for pair in SOURCE_NAMES.items() for x in pair])
    fetched = with_outcome(landing, deadline_ms).select(
        "search_id",
        F.coalesce(names[F.col("source")], F.col("source")).alias("source_name"),
        "status",
        F.least("latency_ms", F.lit(deadline_ms)).alias("latency_ms"),
        F.when(F.col("status") != "success", F.col("status")).alias("error_type"),
        F.col("error").alias("error_message"),
        F.col("fetched_at").alias("created_at"),
    )
    # The worst fetch of a (search, source) decides; only it has an error kind.
    outcome = fetched.groupBy("search_id", "source_name").agg(
        F.max_by(
            F.struct("status", "error_type", "error_message"),
            F.struct(F.when(F.col("status") != "success", 1).otherwise(0), "created_at", "status"),
        ).alias("o"),
        F.max("latency_ms").alias("latency_ms"),
        F.max("created_at").alias("created_at"),
    )
    counts = results.groupBy("search_id", "source_name").agg(F.count("*").alias("n"))
    return outcome.join(counts, ["search_id", "source_name"], "left").select(
        "search_id",
        "source_name",
        F.col("o.status").alias("status"),
        F.when(F.col("o.status") == "success", F.coalesce("n", F.lit(0))).alias("result_count"),
        "latency_ms",
        F.col("o.error_type").alias("error_type"),
        F.col("o.error_message").alias("error_message"),
        "created_at",
    )


def write_report(report: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines, so equal reports are equal files up to their split."""
    report.select(*sorted(report.columns)).orderBy(*order).write.mode("overwrite").json(path)
