"""Duplicate groups: exact and near matches closed over, annotated, never deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.functions.scoring import type_order
from resultloom.functions.text import with_norm_title
from resultloom.functions.urls import canonical_url, dedupe_key
from resultloom.operators.components import components
from resultloom.operators.fuzzy import (
    MAX_GAP_DAYS,
    THRESHOLD,
    admissible,
    fuzzy_links,
    spans,
    with_word_key,
)
from resultloom.operators.skew import lookup
from resultloom.runtime import materialize

# How a merge is explained.
URL_METHOD = "canonical_url"
TITLE_METHOD = "normalized_title"
FUZZY_METHOD = "fuzzy_title"


def with_keys(results: DataFrame) -> DataFrame:
    """Add canonical URL, dedupe key, comparable title, and the two hub keys.

    ``node`` stands for all rows of a search with one title and type (a row with
    an empty title stands alone); ``hub`` for all rows with one canonical URL.
    """
    keyed = with_norm_title(results).withColumn("canonical_url", canonical_url(F.col("url")))
    titled = F.concat_ws("\x1f", F.lit("t"), "search_id", "source_type", "norm_title")
    alone = F.concat_ws("\x1f", F.lit("r"), "search_id", "id")
    return (
        keyed.withColumn("dedupe_key", dedupe_key(F.col("canonical_url")))
        .withColumn("node", F.md5(F.when(F.col("norm_title") != "", titled).otherwise(alone)))
        .withColumn("hub", F.md5(F.concat_ws("\x1f", "search_id", "canonical_url")))
    )


def star_edges(rows: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Tie every row of a key to the key's least id: n-1 edges, not n(n-1)/2 pairs."""
    least = rows.groupBy(*keys).agg(F.min("id").alias("a"))
    return (
        lookup(rows.select(*keys, "id"), least, keys)
        .filter(F.col("a") != F.col("id"))
        .select("search_id", "a", F.col("id").alias("b"), F.lit(method).alias("method"))
    )


def url_edges(keyed: DataFrame) -> DataFrame:
    return star_edges(keyed, ["search_id", "canonical_url"], URL_METHOD)


def title_edges(keyed: DataFrame) -> DataFrame:
    named = keyed.filter(F.col("norm_title") != "")
    return star_edges(named, ["search_id", "source_type", "norm_title"], TITLE_METHOD)


def _hub_links(keyed: DataFrame, vertex: str, hub: str) -> DataFrame:
    """Star of vertices under each hub that touches more than one."""
    touched = keyed.select(hub, vertex).distinct()
    shared = (
        touched.groupBy(hub)
        .agg(F.min(vertex).alias("a"), F.max(vertex).alias("_top"))
        .filter(F.col("a") != F.col("_top"))
        .drop("_top")
    )
    return (
        lookup(touched, shared, [hub])
        .filter(F.col("a") != F.col(vertex))
        .select("a", F.col(vertex).alias("b"))
    )


# Columns too wide to carry through linking and ranking.
TEXTS = ("description", "raw")


def slim(results: DataFrame) -> DataFrame:
    """The rows with their linking keys but without texts, written once.

    Texts are read here and nowhere later in linking or ranking.
    """
    described = F.length(F.coalesce("description", F.lit("")))
    return materialize(with_keys(results).withColumn("described", described).drop(*TEXTS), "keys")


def _labelled(rows: DataFrame, vertex: str, labels: DataFrame) -> DataFrame:
    """Add the component of each row's vertex; a vertex without links is its own."""
    joined = lookup(rows, labels.withColumnRenamed("node", vertex), [vertex], how="left")
    return joined.withColumn("component", F.coalesce(F.col("component"), F.col(vertex)))


def _cell_key(max_gap_days: float) -> Column:
    gap = int(max_gap_days * 86_400_000_000)
    cell = F.coalesce(F.floor(F.unix_micros("published_at") / gap).cast("string"), F.lit("?"))
    return F.concat_ws("@", "word_key", cell)


def _fuzzy_parts(keyed: DataFrame, threshold: float, max_gap_days: float) -> tuple[DataFrame, ...]:
    """Admissible rows with their time cell, the cells, and the links between cells."""
    rows = with_word_key(admissible(keyed))
    cells = materialize(spans(rows, max_gap_days), "cells")
    links = fuzzy_links(rows, cells, threshold, max_gap_days)
    return rows.withColumn("cell_key", _cell_key(max_gap_days)), cells, links


def canonical_order() -> Column:
    """Least is best: has a time, type, longer description, URL, id."""
    return F.struct(
        F.when(F.col("published_at").isNotNull(), 0).otherwise(1).alias("untimed"),
        type_order(F.col("source_type")).alias("type"),
        (-F.col("described")).alias("shortness"),
        F.col("url"),
        F.col("id"),
    )


def _groups(labelled: DataFrame) -> DataFrame:
    """One row per component of two or more members."""
    return (
        labelled.groupBy("search_id", "component")
        .agg(
            F.count("*").alias("member_count"),
            F.min("id").alias("first_member"),
            F.min(canonical_order()).alias("_best"),
        )
        .filter(F.col("member_count") > 1)
        .withColumn("canonical_id", F.col("_best.id"))
        .withColumn("group_id", F.sha2(F.concat_ws("\x1f", "search_id", "first_member"), 256))
        .drop("_best")
    )


def _evidence(labelled: DataFrame, key: str, method: str, keep: Column | None = None) -> DataFrame:
    """Components in which some key is shared by two rows."""
    rows = labelled if keep is None else labelled.filter(keep)
    return (
        rows.groupBy("component", key)
        .count()
        .filter(F.col("count") > 1)
        .select("component", F.lit(method).alias("method"))
        .distinct()
    )


def _with_methods(groups: DataFrame, evidence: DataFrame) -> DataFrame:
    methods = evidence.groupBy("component").agg(F.sort_array(F.collect_set("method")).alias("methods"))
    return groups.join(methods, "component", "left")


def _exact_links(keyed: DataFrame) -> DataFrame:
    return _hub_links(keyed, "node", "hub")


def _exact_evidence(labelled: DataFrame) -> DataFrame:
    return _evidence(labelled, "hub", URL_METHOD).unionByName(
        _evidence(labelled, "node", TITLE_METHOD, F.col("norm_title") != "")
    )


def exact_groups(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, groups) linked by canonical URL, or by title within a type."""
    keyed = slim(results)
    labelled = materialize(_labelled(keyed, "node", components(_exact_links(keyed))), "labelled")
    return _members(labelled), _with_methods(_groups(labelled), _exact_evidence(labelled))


def fuzzy_groups(
    results: DataFrame, threshold: float = THRESHOLD, max_gap_days: float = MAX_GAP_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(members, groups) linked by near-identical titles close in time, nothing else."""
    rows, _, links = _fuzzy_parts(slim(results), threshold, max_gap_days)
    labelled = materialize(_labelled(rows, "cell_key", components(links)), "labelled")
    groups = _groups(labelled).withColumn("methods", F.array(F.lit(FUZZY_METHOD)))
    return _members(labelled), groups


def _closed(
    keyed: DataFrame, threshold: float, max_gap_days: float
) -> tuple[DataFrame, DataFrame]:
    """(rows with component, groups) over every kind of link at once."""
    rows, cells, links = _fuzzy_parts(keyed, threshold, max_gap_days)
    # A cell is a hub for the titles it holds, and linked cells are tied by one title of each.
    named = cells.select("cell_key", "node")
    tied = (
        links.join(named.select(F.col("cell_key").alias("a"), F.col("node").alias("na")), "a")
        .join(named.select(F.col("cell_key").alias("b"), F.col("node").alias("nb")), "b")
        .select(F.col("na").alias("a"), F.col("nb").alias("b"))
    )
    edges = (
        _exact_links(keyed)
        .unionByName(_hub_links(rows, "node", "cell_key"))
        .unionByName(tied)
    )
    labels = components(edges)
    labelled = materialize(_labelled(keyed, "node", labels), "labelled")
    # A near match shows in a cell of two or more rows, or at the end of any link.
    linked = links.select(F.explode(F.array("a", "b")).alias("cell_key")).distinct()
    crowded = cells.filter(F.col("n") > 1).select("node")
    near = crowded.unionByName(linked.join(named, "cell_key").select("node")).distinct()
    fuzzy_evidence = (
        near.join(labels, "node", "left")
        .select(F.coalesce("component", "node").alias("component"), F.lit(FUZZY_METHOD).alias("method"))
        .distinct()
    )
    evidence = _exact_evidence(labelled).unionByName(fuzzy_evidence)
    return labelled, _with_methods(_groups(labelled), evidence)


def all_groups(
    results: DataFrame, threshold: float = THRESHOLD, max_gap_days: float = MAX_GAP_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(members, groups) closed over every kind of link at once."""
    labelled, groups = _closed(slim(results), threshold, max_gap_days)
    return _members(labelled), groups


def _members(labelled: DataFrame) -> DataFrame:
    return labelled.select("search_id", "id", "component")


def annotate(
    results: DataFrame, threshold: float = THRESHOLD, max_gap_days: float = MAX_GAP_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(annotated rows, groups): every row stays, members learn group and role.

    The annotated rows carry every column but the texts; ``with_texts`` adds those
    of the rows that are to be shown.
    """
    keyed = slim(results)
    labelled, found = _closed(keyed, threshold, max_gap_days)
    groups = materialize(found, "groups")
    chosen = groups.select("component", F.col("group_id").alias("duplicate_group_id"), "canonical_id")
    annotated = (
        lookup(labelled, chosen, ["component"], how="left")
        .withColumn(
            "is_duplicate",
            F.col("duplicate_group_id").isNotNull() & (F.col("id") != F.col("canonical_id")),
        )
        .drop("component", "canonical_id", "node", "hub", "described")
    )
    return annotated, groups.drop("component", "first_member")


def with_texts(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Give rows their texts back from the stored results."""
    texts = [c for c in TEXTS if c in results.columns]
    return rows.join(results.select("search_id", "id", *texts), ["search_id", "id"])


def dedup_stats(groups: DataFrame, searches: DataFrame) -> DataFrame:
    """Groups and duplicates of each search, zeros included."""
    per = groups.groupBy("search_id").agg(
        F.count("*").alias("groups"), F.sum(F.col("member_count") - 1).alias("duplicates")
    )
    return searches.select("search_id").join(per, "search_id", "left").na.fill(0, ["groups", "duplicates"])


def also_reported_by(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources, and URLs, of each group as rows, so a large group needs no large array."""
    members = annotated.filter(F.col("duplicate_group_id").isNotNull())
    sources = members.groupBy("search_id", "duplicate_group_id", "source_name").agg(
        F.count("*").alias("rows")
    )
    urls = members.select("search_id", "duplicate_group_id", "url").distinct()
    return sources, urls
