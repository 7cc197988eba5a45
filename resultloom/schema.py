"""Record shapes shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source types, event outcomes, search states.
SOURCE_TYPES = ("news", "social", "reference")

RESULT = T.StructType(
    [
        T.StructField("search_id", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("source_type", T.StringType(), False),
        T.StructField("source_name", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType(), False),
        T.StructField("author", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("retrieved_at", T.TimestampType(), False),
        T.StructField("language", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

LANDING = T.StructType(
    [
        T.StructField("search_id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("fetched_at", T.TimestampType(), False),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("body", T.StringType()),
    ]
)


def to_results(df: DataFrame) -> DataFrame:
    """Project any frame onto the canonical result columns, in order and type."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RESULT.fields
        ]
    )


def contract_violations(df: DataFrame) -> DataFrame:
    """Rows that miss a mandatory field of the canonical record, one per field."""
    mandatory = [f.name for f in RESULT.fields if not f.nullable]
    broken: Column = F.filter(
        F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in mandatory]),
        lambda name: name.isNotNull(),
    )
    return df.select("search_id", "id", F.explode(broken).alias("missing_field"))
