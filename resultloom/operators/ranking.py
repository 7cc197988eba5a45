"""Scores and total orders of search results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.functions.scoring import (
    BAND_WIDTH,
    DESIGN_WEIGHTS,
    TYPE_ORDER,
    WIDE_TYPE_ORDER,
    freshness,
    instant,
    lexical_overlap,
    share_of_max,
    source_quality,
    type_order,
    weighted,
)
from resultloom.functions.text import token_set
from resultloom.operators.dedup import TEXTS
from resultloom.operators.skew import TASK_ROWS, largest_group, lookup, position
from resultloom.runtime import materialize

KEYS = ("search_id",)


def newest_first() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("url"), F.col("id")]


def with_overlap(results: DataFrame, searches: DataFrame) -> DataFrame:
    """Add the raw lexical score of each result against its search's query."""
    terms = searches.select("search_id", token_set(F.col("query")).alias("_terms"))
    scored = lookup(results, terms, KEYS)
    overlap = lexical_overlap(F.col("_terms"), F.col("title"), F.col("description"))
    return scored.withColumn("raw_relevance", overlap).drop("_terms")


def with_relevance(results: DataFrame, searches: DataFrame) -> DataFrame:
    """Add raw relevance (unless the rows carry it) and its share of the best in the search."""
    scored = results if "raw_relevance" in results.columns else with_overlap(results, searches)
    best = scored.groupBy(*KEYS).agg(F.max("raw_relevance").alias("_best"))
    return (
        lookup(scored, best, KEYS)
        .withColumn("relevance", share_of_max(F.col("raw_relevance"), F.col("_best")))
        .drop("_best")
    )


def with_components(results: DataFrame, searches: DataFrame, now: datetime | str) -> DataFrame:
    """Add each row's own relevance, freshness and quality."""
    return (
        with_relevance(results, searches)
        .withColumn(
            "freshness", freshness(F.col("published_at"), F.col("source_type"), instant(now))
        )
        .withColumn("quality", source_quality(F.col("source_type"), F.col("source_name")))
    )


def inherit_from_canonical(components: DataFrame) -> DataFrame:
    """Give duplicates the components and scored type of their group's canonical row.

    A group without one, and a row without a group, keep their own. Each group is
    reduced to its first canonical row before it meets its members.
    """
    carried = F.struct("id", "relevance", "freshness", "quality", "source_type")
    canonical = (
        components.filter(F.col("duplicate_group_id").isNotNull() & ~F.col("is_duplicate"))
        .groupBy("search_id", "duplicate_group_id")
        .agg(F.min(carried).alias("_of"))
    )
    joined = lookup(components, canonical, ["search_id", "duplicate_group_id"], how="left")
    for name in ("relevance", "freshness", "quality"):
        joined = joined.withColumn(name, F.coalesce(F.col("_of")[name], F.col(name)))
    return joined.withColumn(
        "scored_type", F.coalesce(F.col("_of")["source_type"], F.col("source_type"))
    ).drop("_of")


def with_score(components: DataFrame, weights: dict = DESIGN_WEIGHTS, out: str = "rank_score") -> DataFrame:
    return components.withColumn(
        out,
        weighted(
            F.col("relevance"), F.col("freshness"), F.col("quality"), F.col("scored_type"), weights
        ),
    )


def _folded_anchors(scores: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Band anchors by one pass over each group's distinct scores, for groups one task can hold."""
    ordered = F.sort_array(F.collect_set("rank_score"), asc=False)
    start = F.array().cast("array<double>")
    anchors = F.aggregate(
        ordered,
        start,
        lambda found, s: F.when(
            (F.size(found) == 0) | (F.element_at(found, -1) - s > width),
            F.concat(found, F.array(s)),
        ).otherwise(found),
    )
    return scores.groupBy(*keys).agg(anchors.alias("anchors"))


def _searched_anchors(scores: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Band anchors by repeated maxima, for groups of any size.

    Each round takes the highest score more than ``width`` below the last anchor,
    with partial maxima per task. Scores lie in [0, 1], so there are at most
    1/width + 1 rounds and anchors, whatever the number of rows.
    """
    distinct = materialize(scores.select(*keys, "rank_score").distinct(), "scores")
    last = materialize(distinct.groupBy(*keys).agg(F.max("rank_score").alias("anchor")), "anchor")
    found = last
    while True:
        below = lookup(distinct, last, keys).filter(
            F.col("anchor") - F.col("rank_score") > width
        )
        last = materialize(below.groupBy(*keys).agg(F.max("rank_score").alias("anchor")), "anchor")
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list("anchor"), asc=False).alias("anchors"))


def with_bands(
    scored: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    width: float = BAND_WIDTH,
    task_rows: int = TASK_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add the 0-based greedy band: a band runs from its first score down by ``width``."""
    if largest is None:
        largest = largest_group(scored, keys)
    find = _folded_anchors if largest <= task_rows else _searched_anchors
    banded = lookup(scored, find(scored, keys, width), keys)
    above = F.size(F.filter("anchors", lambda a: a >= F.col("rank_score")))
    return banded.withColumn("band", above - 1).drop("anchors")


def alternate_types(
    banded: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    out: str = "rank_position",
    task_rows: int = TASK_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """0-based final place: bands in order, source types in turn inside a band.

    Only the turn of a row inside its (band, type) is an ordering; its place then
    follows from the sizes of the bands and types, at most four per band.
    """
    prio = type_order(F.col("source_type"))
    rows = position(
        banded.withColumn("_type", prio),
        [*keys, "band", "_type"],
        newest_first(),
        "turn",
        task_rows=task_rows,
        largest=largest,
    )
    sizes = banded.withColumn("_type", prio).groupBy(*keys, "band", "_type").agg(F.count("*").alias("n"))
    per_group = sizes.groupBy(*keys).agg(
        F.collect_list(F.struct("band", "_type", "n")).alias("sizes")
    )
    placed = lookup(rows, per_group, keys)

    def ahead(s: Column) -> Column:
        same = s["band"] == F.col("band")
        whole_turns = F.least(s["n"], F.col("turn") - 1)
        this_turn = F.when((s["_type"] < F.col("_type")) & (s["n"] >= F.col("turn")), 1).otherwise(0)
        return (
            F.when(s["band"] < F.col("band"), s["n"])
            .when(same, whole_turns + this_turn)
            .otherwise(F.lit(0).cast("long"))
        )

    place = F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, s: acc + ahead(s))
    return placed.withColumn(out, place).drop("sizes", "_type")


def score_order() -> list[Column]:
    """Score first, then type, newest, URL and id."""
    return [F.col("rank_score").desc(), type_order(F.col("source_type")), *newest_first()]


def rank_results(
    results: DataFrame,
    searches: DataFrame,
    now: datetime | str,
    *,
    weights: dict = DESIGN_WEIGHTS,
    diversity: bool = True,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Score every result and place it in its search (0-based ``rank_position``).

    Texts are read for the raw relevance only, and not carried further.
    """
    rows = results if "raw_relevance" in results.columns else with_overlap(results, searches)
    parts = materialize(with_components(rows.drop(*TEXTS), searches, now), "components")
    largest = largest_group(parts, KEYS)
    scored = materialize(with_score(inherit_from_canonical(parts), weights), "scored")
    if not diversity:
        placed = position(
            scored, KEYS, score_order(), "rank_position", task_rows=task_rows, largest=largest
        )
        return placed.withColumn("rank_position", F.col("rank_position") - 1)
    banded = with_bands(scored, task_rows=task_rows, largest=largest)
    return alternate_types(banded, task_rows=task_rows, largest=largest)


def baseline_positions(results: DataFrame, searches: DataFrame, **kw) -> DataFrame:
    """Lexical order: raw score, type, title, id (1-based ``position``)."""
    scored = with_overlap(results, searches)
    order = [
        F.col("raw_relevance").desc(),
        type_order(F.col("source_type"), WIDE_TYPE_ORDER),
        F.col("title"),
        F.col("id"),
    ]
    kw.setdefault("largest", largest_group(results, KEYS))
    return position(scored, KEYS, order, **kw)


def serving_order() -> list[Column]:
    """Stored place first; rows of a search still running fall back to type, newest, URL."""
    return [
        F.col("rank_position").asc_nulls_last(),
        type_order(F.col("source_type"), TYPE_ORDER),
        *newest_first(),
    ]
