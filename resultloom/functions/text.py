"""Titles, tokens and queries as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Publisher names that may end a title.
PUBLISHERS = (
    "the guardian",
    "guardian",
    "bbc",
    "bbc news",
    "reuters",
    "cnn",
    "the new york times",
    "washington post",
    "bloomberg",
    "the verge",
    "arstechnica",
    "global wire",
    "ap news",
    "associated press",
)

# Words BM25 leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with",
)

_SUFFIXES = r"(?U)(?:\s*[-|—–]\s*(?:" + "|".join(PUBLISHERS) + r"))+\z"

# Letters that compatibility composition leaves as they are: ASCII and the
# precomposed Latin letters. Titles with anything else take the Arrow path.
_COMPOSED = (
    r"\A[\x00-\x7F¡-§©«-®°±¶·»"
    r"¿-ıĴ-ľŁ-ňŊ-ž‐‒-―"
    r"‘-„†-•€]*\z"
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold_title(composed: Column) -> Column:
    """Comparable form of a title whose characters are already composed."""
    bare = F.regexp_replace(F.lower(strip(composed)), _SUFFIXES, "")
    return squeeze(F.regexp_replace(bare, r"(?U)[^\p{L}\p{N}_\s]", " "))


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no built-in for."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def with_norm_title(df: DataFrame, title: str = "title", out: str = "norm_title") -> DataFrame:
    """Add the comparable title.

    Rows are read once; only the rare titles that need composing go to Python,
    the others pass as nulls.
    """
    raw = F.col(title)
    composed = F.coalesce(compose(F.when(~raw.rlike(_COMPOSED), raw)), raw)
    return df.withColumn(out, fold_title(composed))


def tokens(text: Column) -> Column:
    """ASCII words in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def content_tokens(text: Column) -> Column:
    """ASCII words in order without the stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))


def title_words(norm_title: Column) -> Column:
    """Sorted distinct words of a comparable title, which is all fuzzy matching sees."""
    return F.array_sort(F.array_distinct(F.filter(F.split(norm_title, " "), lambda w: w != "")))


def normalize_query(query: Column) -> Column:
    return squeeze(F.lower(query))


def clean_queries(requests: DataFrame) -> DataFrame:
    """Accepted search requests: trimmed text of 1..200 characters, window 0..8760 hours (0 = none)."""
    cleaned = requests.withColumn("query", strip(F.col("query")))
    length = F.length("query")
    window = F.col("window_hours")
    return (
        cleaned.filter(length.between(1, 200) & (window.isNull() | window.between(0, 8760)))
        .withColumn("window_hours", F.nullif(window, F.lit(0)))
        .withColumn("normalized_query", normalize_query(F.col("query")))
    )


def shorten(text: Column, width: int = 46) -> Column:
    """One line of at most ``width`` characters, cut ones ending in three dots."""
    line = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(line) <= width, line).otherwise(
        F.concat(F.substring(line, 1, width - 3), F.lit("..."))
    )


def shown_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("not provided"))
