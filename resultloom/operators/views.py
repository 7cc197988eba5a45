"""Read-only views over stored results: filters, pages, history."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.operators.ranking import KEYS, serving_order
from resultloom.operators.skew import lookup, position
from resultloom.schema import SOURCE_TYPES

# Accepted filter values.
TIME_WINDOWS = {"24h": 24, "7d": 168, "30d": 720}
DUPLICATE_MODES = ("all", "canonical")
LANGUAGE = re.compile(r"[a-z]{2,3}")
MAX_PAGE = 100

PUBLIC_COLUMNS = (
    "source_type", "source_name", "title", "description", "url", "author",
    "published_at", "retrieved_at", "language", "is_duplicate", "duplicate_group_id",
)


def check_filters(
    source_types: Sequence[str] | None = None,
    time: str = "all",
    duplicates: str = "all",
    language: str | None = None,
) -> None:
    """Reject values no filter knows; none is ever ignored."""
    for value in source_types or ():
        if value not in SOURCE_TYPES:
            raise ValueError(f"unknown source type {value!r}; expected one of {SOURCE_TYPES}")
    if time != "all" and time not in TIME_WINDOWS:
        raise ValueError(f"unknown time window {time!r}; expected 'all' or one of {list(TIME_WINDOWS)}")
    if duplicates not in DUPLICATE_MODES:
        raise ValueError(f"unknown duplicates mode {duplicates!r}; expected one of {DUPLICATE_MODES}")
    if language is not None and not LANGUAGE.fullmatch(language):
        raise ValueError(f"invalid language {language!r}; expected 2 or 3 lowercase letters")


def check_page(page: int, per_page: int) -> None:
    if page < 1:
        raise ValueError("page starts at 1")
    if not 1 <= per_page <= MAX_PAGE:
        raise ValueError(f"per_page is 1..{MAX_PAGE}")


def cutoff(time: str) -> Column | None:
    """Start of a time view, fixed by when the search completed (or else began)."""
    if time not in TIME_WINDOWS:
        return None
    anchor = F.coalesce("completed_at", "created_at")
    return anchor - F.expr(f"INTERVAL {TIME_WINDOWS[time]} HOURS")


def recent(since: Column) -> Column:
    """Reference rows, and rows known to be published at or after ``since``."""
    dated = F.col("published_at").isNotNull() & (F.col("published_at") >= since)
    return (F.col("source_type") == "reference") | dated


def filtered(
    results: DataFrame,
    searches: DataFrame | None = None,
    *,
    source_types: Sequence[str] | None = None,
    time: str = "all",
    duplicates: str = "all",
    language: str | None = None,
) -> DataFrame:
    """The rows of a view. It only selects: no score, place or group changes.

    A time view needs ``searches`` for its cutoff.
    """
    check_filters(source_types, time, duplicates, language)
    view = results
    if source_types:
        view = view.filter(F.col("source_type").isin(*source_types))
    if language is not None:
        view = view.filter(F.col("language") == language)
    if duplicates == "canonical":
        view = view.filter(~F.col("is_duplicate"))
    since = cutoff(time)
    if since is not None:
        if searches is None:
            raise ValueError("a time view needs the searches")
        starts = searches.select("search_id", since.alias("_since"))
        view = lookup(view, starts, KEYS).filter(recent(F.col("_since"))).drop("_since")
    return view


def public(view: DataFrame) -> DataFrame:
    """What a reader may see: neither raw payload nor scores."""
    return view.select("search_id", *PUBLIC_COLUMNS)


def pages(view: DataFrame, page: int = 1, per_page: int = 20, **kw) -> DataFrame:
    """The given page of every search in the view, with its place in the view."""
    check_page(page, per_page)
    start = (page - 1) * per_page
    placed = position(view, KEYS, serving_order(), "view_position", **kw)
    return placed.filter(F.col("view_position").between(start + 1, start + per_page))


def page_of(view: DataFrame, search_id: str, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of one search: a top-n of the rows up to its end."""
    check_page(page, per_page)
    rows = view.filter(F.col("search_id") == search_id)
    return rows.orderBy(*serving_order()).offset((page - 1) * per_page).limit(per_page)


def totals(view: DataFrame, per_page: int = 20) -> DataFrame:
    """Rows and pages of each search in the view; an empty search still has one page."""
    check_page(1, per_page)
    return view.groupBy(*KEYS).agg(F.count("*").alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long")
    )


def result_counts(searches: DataFrame, results: DataFrame) -> DataFrame:
    counts = results.groupBy(*KEYS).agg(F.count("*").alias("result_count"))
    return searches.join(counts, list(KEYS), "left").na.fill(0, ["result_count"])


def history(searches: DataFrame, results: DataFrame, limit: int = 20) -> DataFrame:
    """The newest searches with their result counts."""
    check_page(1, limit)
    newest = searches.orderBy(F.col("created_at").desc(), "search_id").limit(limit)
    return result_counts(newest, results.join(newest.select("search_id"), "search_id", "left_semi"))


def search_detail(searches: DataFrame, events: DataFrame, results: DataFrame) -> DataFrame:
    """Each search with one row per source event, null where none arrived yet."""
    told = result_counts(searches, results)
    return lookup_events(told, events)


def lookup_events(searches: DataFrame, events: DataFrame) -> DataFrame:
    shown = events.select(
        "search_id",
        F.col("source_name").alias("source"),
        F.col("status").alias("source_status"),
        F.col("result_count").alias("source_results"),
        F.col("latency_ms").alias("source_latency_ms"),
        F.col("error_type"),
        F.col("created_at").alias("source_at"),
    )
    return searches.join(shown, "search_id", "left")


def search_status(events: DataFrame) -> DataFrame:
    """completed when all sources answered, failed when none did, else partial."""
    failed = F.sum(F.when(F.col("status") != "success", 1).otherwise(0))
    return events.groupBy(*KEYS).agg(failed.alias("failed"), F.count("*").alias("sources")).withColumn(
        "status",
        F.when(F.col("failed") == 0, "completed")
        .when(F.col("failed") < F.col("sources"), "partial")
        .otherwise("failed"),
    )


def find_search(searches: DataFrame, search_id: str) -> DataFrame:
    return searches.filter(F.col("search_id") == search_id)
