"""Checks on labelled data: every violation is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a labelled item may hold.
LABELLED_TYPES = ("news", "social", "reference", "video")
GRADES = (0, 1, 2)
ID_PATTERN = r"\A[a-z0-9_]+\z"


def _violations(df: DataFrame, rule: str, subject: str, where: Column) -> DataFrame:
    return df.filter(where).select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def item_violations(items: DataFrame) -> DataFrame:
    """Field rules of items (query_id, id, title, url, source_type, source_name, rel, times)."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "id_pattern": ~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False)),
        "title_missing": missing("title"),
        "source_name_missing": missing("source_name"),
        "url_not_absolute": ~F.coalesce(F.col("url").startswith("http"), F.lit(False)),
        "unknown_type": ~F.coalesce(F.col("source_type").isin(*LABELLED_TYPES), F.lit(False)),
        "unknown_grade": ~F.coalesce(F.col("rel").isin(*GRADES), F.lit(False)),
        "retrieved_at_missing": F.col("retrieved_at").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    fields = items.select(F.explode(found).alias("rule"), F.col("id").alias("subject"))
    repeated = items.groupBy("id").count()
    return fields.unionByName(_violations(repeated, "id_repeated", "id", F.col("count") > 1))


def group_violations(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Members of gold groups (group_id, id): known, unique, one query, one group, two or more."""
    owned = gold.join(items.select("id", "query_id").distinct(), "id", "left")
    per_group = gold.groupBy("group_id").agg(F.count("*").alias("n"))
    repeated = gold.groupBy("group_id", "id").count()
    several = gold.select("group_id", "id").distinct().groupBy("id").count()
    spread = owned.groupBy("group_id").agg(
        F.min("query_id").alias("lo"), F.max("query_id").alias("hi")
    )
    unknown = gold.join(items.select("id").distinct(), "id", "left_anti")
    return _union(
        [
            _violations(per_group, "group_too_small", "group_id", F.col("n") < 2),
            _violations(repeated, "member_repeated", "id", F.col("count") > 1),
            _violations(several, "member_in_several_groups", "id", F.col("count") > 1),
            _violations(spread, "group_spans_queries", "group_id", F.col("lo") != F.col("hi")),
            _violations(unknown, "member_unknown", "id", F.lit(True)),
        ]
    )


def pair_violations(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ambiguous pairs (a, b): two different known items of one query."""
    owner = items.select("id", "query_id").distinct()
    told = pairs.withColumn("pair", F.concat_ws("|", "a", "b"))
    ends = told.select("pair", F.explode(F.array("a", "b")).alias("id"))
    unknown = ends.join(owner, "id", "left_anti")
    spread = (
        ends.join(owner, "id")
        .groupBy("pair")
        .agg(F.min("query_id").alias("lo"), F.max("query_id").alias("hi"))
    )
    return _union(
        [
            _violations(told, "pair_not_distinct", "pair", F.col("a") == F.col("b")),
            _violations(unknown, "pair_item_unknown", "id", F.lit(True)),
            _violations(spread, "pair_spans_queries", "pair", F.col("lo") != F.col("hi")),
        ]
    )


def corpus_violations(items: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    return _union([item_violations(items), group_violations(items, gold), pair_violations(items, pairs)])


def corpus_summary(items: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """Queries, items, gold groups and ambiguous pairs, one row each."""
    def count(df: DataFrame, what: str, n: Column) -> DataFrame:
        return df.agg(n.alias("n")).select(F.lit(what).alias("what"), "n")

    queries = items.select("query_id").distinct()
    groups = gold.select("group_id").distinct()
    return _union(
        [
            count(queries, "queries", F.count("*")),
            count(items, "items", F.count("*")),
            count(groups, "groups", F.count("*")),
            count(pairs, "ambiguous_pairs", F.count("*")),
        ]
    )
