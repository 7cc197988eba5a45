"""Joins and orderings that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultloom.runtime import materialize

# A group of up to this many rows may be sorted or folded by one task. Larger
# ones are cut into slices. It bounds a task, not the answer.
TASK_ROWS = 500_000


def lookup(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], *, how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Join many rows to a frame that holds one row per key.

    The many rows are the left side: Spark splits a key with much of the data over several
    tasks and gives each the key's one row, and only such keys
    (``spark.sql.adaptive.skewJoin.enabled``). With ``null_safe`` a null key meets a null key.
    """
    if not null_safe:
        return rows.join(per_key, [*keys], how)
    renamed = per_key.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group: partial counts per task, one number back."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    *,
    weight: Column | None = None,
    task_rows: int = TASK_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` in each group (row number when none).

    ``order`` must be total inside a group. Groups that fit one task use one
    window. Otherwise rows are range partitioned on key and order, so a large
    group covers many slices; each slice adds up on its own and takes the sum
    of the slices before it, of which a group has at most one per partition.
    """
    value = F.lit(1).cast("long") if weight is None else weight
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= task_rows:
        window = Window.partitionBy(*keys).orderBy(*order)
        if weight is None:
            return df.withColumn(out, F.row_number().over(window).cast("long"))
        window = window.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(window))

    ranged = df.withColumn("_w", value).repartitionByRange(*[F.col(k) for k in keys], *order)
    sliced = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_w").alias("_part"))
        .select(*keys, "_slice", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        lookup(sliced.withColumn("_in", F.sum("_w").over(inside)), offsets, [*keys, "_slice"], null_safe=True)
        .withColumn(out, F.col("_in") + F.col("_base"))
        .drop("_in", "_base", "_slice", "_w")
    )


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "position",
    **kw,
) -> DataFrame:
    """1-based place of each row in its group, for groups of any size."""
    return running_total(df, keys, order, out, **kw)
