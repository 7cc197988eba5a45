"""Exact copies: grouped by a 128-bit content hash, and compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.operators.skew import lookup
from resultloom.runtime import materialize

# White space, which texts may differ in.
SPACE = " \t\n\x0b\x0c\r"


def without_space(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def content_key(normal: Column) -> Column:
    """128 bits of a text's bytes."""
    return F.unhex(F.md5(normal))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size and keeper of each group: most code points, then smallest id, null last, then first read."""
    place = F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min(place).alias("first"))
    return found.select(*keys, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))


def _decided(docs: DataFrame, normal: Column | None, key: Callable[[Column], Column]) -> DataFrame:
    normal = without_space(F.col("text")) if normal is None else normal
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normal.alias("normal")
    ).withColumn("key", key(F.col("normal")))
    row, digest = F.monotonically_increasing_id().alias("row"), F.sha2("normal", 256).alias("text_sha256")
    # Narrow rows are written once: the number of a row is then the same wherever it is asked for.
    narrow = materialize(read.select(row, "doc_id", "n_points", "key", digest), "contents")
    # Equal texts of a task collapse before the shuffle, so a hot group sends one text per task.
    texts = read.select("key", "normal").distinct()
    unlike = materialize(texts.groupBy("key").count().filter("count > 1").select("key"), "collisions")
    columns = ["row", "doc_id", "n_points", "text_sha256", "group_size", "keep_id", "keep_row"]
    if unlike.isEmpty():
        copies = _groups(narrow, ["key"]).filter("group_size > 1")
        done = lookup(narrow, copies, ["key"], how="left").select(*columns)
    else:
        # Rows whose hash stands for unlike texts are grouped by the texts themselves.
        plain = narrow.join(unlike, "key", "left_anti")
        copies = _groups(plain, ["key"]).filter("group_size > 1")
        again = materialize(read.join(unlike, "key", "left_semi").select(row, "doc_id", "n_points", "normal", digest), "collided")
        done = lookup(plain, copies, ["key"], how="left").select(*columns).unionByName(
            lookup(again, _groups(again, ["normal"]), ["normal"]).select(*columns)
        )
    alone = F.col("group_size").isNull()
    return done.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", "n_points",
    )


def mark_copies(docs: DataFrame, *, normal: Column | None = None, key: Callable[[Column], Column] = content_key) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs`` (doc_id, text).

    Texts are equal when ``normal`` of them is, by default the text without ASCII white space. Rows are
    grouped by a 128-bit hash of it (``key``); the normal texts of each hash are compared whole, and
    where one hash stands for several, its rows are grouped by text instead. Of equal texts the
    row with the most code points stays, then that of the smallest doc_id.

    A null text is an empty one, and empty texts are copies of each other. A null id comes after all others; rows that
    agree in text length and id are told apart by the order they are read in, so one of them stays.
    An empty table gives no rows. Other columns are ignored.
    """
    return _decided(docs, normal, key).drop("n_points")


def drop_copies(docs: DataFrame, *, normal: Column | None = None, key: Callable[[Column], Column] = content_key) -> DataFrame:
    """``docs``, all columns, without the rows that ``mark_copies`` does not keep."""
    text = without_space(F.col("text")) if normal is None else normal
    kept = _decided(docs, normal, key).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("n_points").alias("_points"), F.col("text_sha256").alias("_sha")
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.length(F.coalesce("text", F.lit(""))).alias("points"), text.alias("normal"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("points") == F.col("_points")) & (F.sha2("normal", 256) == F.col("_sha"))
    stay = rows.join(kept, same, "left_semi").groupBy("id", "points", "normal").agg(F.first("row").alias("row"))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
