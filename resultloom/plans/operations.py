"""How searches and sources behave: timings, health, states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.operators.statistics import upper_median, value_at


def source_health(events: DataFrame, **kw) -> DataFrame:
    """Outcomes, success rate and exact latency percentiles of each source."""
    key = ["source_name"]
    outcome = lambda s: F.count_if(F.col("status") == s)
    summary = events.groupBy(*key).agg(
        F.count("*").alias("events"),
        outcome("success").alias("success"),
        outcome("failed").alias("failed"),
        outcome("timeout").alias("timeout"),
        outcome("rate_limited").alias("rate_limited"),
        F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)).alias("success_rate"),
        F.min("latency_ms").alias("best_ms"),
    )
    p50 = upper_median(events, key, "latency_ms", "p50_ms", **kw)
    p95 = value_at(events, key, "latency_ms", lambda n: F.ceil(n * 0.95), "p95_ms", **kw)
    return summary.join(p50, key, "left").join(p95, key, "left")


def search_timings(events: DataFrame) -> DataFrame:
    """Time each search spent waiting for its sources: the slowest one decides."""
    return events.groupBy("search_id").agg(
        F.max("latency_ms").alias("sources_ms"),
        F.sum("latency_ms").alias("busy_ms"),
        F.count("*").alias("sources"),
    )


def arrival_times(searches: DataFrame, results: DataFrame) -> DataFrame:
    """Milliseconds from creation to the first result, and to completion, of each search."""
    first = results.groupBy("search_id").agg(F.min("retrieved_at").alias("first_at"))
    ms = lambda c: (F.unix_micros(c) - F.unix_micros("created_at")) / 1000.0
    return searches.join(first, "search_id", "left").select(
        "search_id", ms("first_at").alias("first_ms"), ms("completed_at").alias("done_ms")
    )


def arrival_summary(
    arrivals: DataFrame, first_target_ms: float = 3000.0, done_target_ms: float = 5000.0, **kw
) -> DataFrame:
    """Best, middle and 95th percentile times, and searches beyond their targets.

    Percentiles are of the searches that were answered; one never answered counts as late.
    """
    late = lambda c, limit: F.count_if(F.coalesce(F.col(c) > limit, F.lit(True)))
    every = arrivals.withColumn("_all", F.lit(0))
    out = every.groupBy("_all").agg(
        F.count("*").alias("searches"),
        F.min("first_ms").alias("best_first_ms"),
        F.min("done_ms").alias("best_done_ms"),
        late("first_ms", first_target_ms).alias("late_first"),
        late("done_ms", done_target_ms).alias("late_done"),
    )
    for name in ("first", "done"):
        out = out.join(upper_median(every, ["_all"], f"{name}_ms", f"p50_{name}_ms", **kw), "_all", "left")
        p95 = value_at(every, ["_all"], f"{name}_ms", lambda n: F.ceil(n * 0.95), f"p95_{name}_ms", **kw)
        out = out.join(p95, "_all", "left")
    return out.drop("_all")


def throughput(searches: DataFrame) -> DataFrame:
    """Completed searches per second between the first start and the last end."""
    done = searches.filter(F.col("completed_at").isNotNull())
    wall = (F.max(F.unix_micros("completed_at")) - F.min(F.unix_micros("created_at"))) / 1e6
    return done.agg(F.count("*").alias("searches"), wall.alias("wall_s")).withColumn(
        "per_second", F.col("searches") / F.nullif("wall_s", F.lit(0.0))
    )


def with_deadline(fetches: DataFrame, deadline_ms: int = 4500) -> DataFrame:
    """A source that answered after the deadline, or never, timed out at the deadline."""
    late = F.coalesce(F.col("latency_ms") > deadline_ms, F.lit(True))
    return fetches.withColumn("status", F.when(late, "timeout").otherwise(F.col("status"))).withColumn(
        "latency_ms", F.when(late, F.lit(deadline_ms)).otherwise(F.col("latency_ms")).cast("long")
    )
