"""Exact order statistics and rank correlation from value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.operators.skew import lookup, running_total


def _value_counts(df: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    """Distinct values of each group with their count and the count up to them."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running_total(counts, keys, [F.col(value)], "upto", weight=F.col("n"), **kw)


def value_at(df: DataFrame, keys: Sequence[str], value: str, place, out: str, **kw) -> DataFrame:
    """Value at the 1-based ``place(total)`` of each group in ascending order."""
    rows = df.filter(F.col(value).isNotNull())
    counts = _value_counts(rows, keys, value, **kw)
    total = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    wanted = place(F.col("total"))
    found = lookup(counts, total, keys, null_safe=True).filter(
        (F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)
    )
    return found.select(*keys, F.col(value).alias(out))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    """The value at index n div 2 (0-based) of the sorted values."""
    return value_at(df, keys, value, lambda n: F.floor(n / 2) + 1, out, **kw)


def median(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    """Middle value, or mean of the two middle ones."""
    rows = df.filter(F.col(value).isNotNull())
    counts = _value_counts(rows, keys, value, **kw)
    total = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    before = F.col("upto") - F.col("n")
    hit = lambda place: (F.col("upto") >= place) & (before < place)
    return (
        lookup(counts, total, keys, null_safe=True)
        .filter(hit(low) | hit(high))
        .groupBy(*keys)
        .agg(((F.min(value) + F.max(value)) / 2).alias(out))
    )


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    """Rank of each distinct value, ties sharing their mean rank."""
    counts = _value_counts(df, keys, value, **kw)
    return counts.withColumn(out, F.col("upto") - (F.col("n") - 1) / 2).drop("upto", "n")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, **kw) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` per group; NaN below 3 rows or without variance."""
    pairs = df.groupBy(*keys, x, y).agg(F.count("*").alias("w"))
    ranked = lookup(pairs, mid_ranks(df, keys, x, "rx", **kw), [*keys, x], null_safe=True)
    ranked = lookup(ranked, mid_ranks(df, keys, y, "ry", **kw), [*keys, y], null_safe=True)
    total = df.groupBy(*keys).agg(F.count("*").alias("total"))
    middle = (F.col("total") + 1) / 2
    centred = (
        lookup(ranked, total, keys, null_safe=True)
        .withColumn("dx", F.col("rx") - middle)
        .withColumn("dy", F.col("ry") - middle)
    )
    sums = centred.groupBy(*keys).agg(
        F.max("total").alias("n"),
        F.sum(F.col("w") * F.col("dx") * F.col("dy")).alias("sxy"),
        F.sum(F.col("w") * F.col("dx") * F.col("dx")).alias("sxx"),
        F.sum(F.col("w") * F.col("dy") * F.col("dy")).alias("syy"),
    )
    defined = (F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    rho = F.when(defined, F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).otherwise(float("nan"))
    return sums.select(*keys, "n", rho.alias("rho"))
