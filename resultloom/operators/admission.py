"""Admission limits: a sliding window of admitted hits per key, and a cap on running searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resultloom.operators.skew import lookup

# Default limits.
MAX_HITS = 30
WINDOW_SECONDS = 60.0
MAX_RUNNING = 8


class Limit:
    """Admits a hit unless ``most`` were admitted in the window up to it.

    Of the admitted times only the last ``most`` are held, so the oldest one held decides: the hit
    must be a full window past it. So the next ``most`` admissions follow from those held: each is the first hit
    a window after its own one, and behind the admission before. They are found together, by
    searches in the times, and hits that are not admitted cost nothing.
    """

    def __init__(self, most: int, micros: int, held=()) -> None:
        self.most, self.micros = most, micros
        self.held = np.array(list(held), np.int64)

    def admits(self, times: np.ndarray) -> np.ndarray:
        """Verdicts on the next hits, whose times are in order."""
        admitted = np.zeros(len(times), bool)
        at = min(len(times), self.most - len(self.held))
        admitted[:at] = True
        self.held = np.concatenate([self.held, times[:at]])
        step = np.arange(self.most)
        while at < len(times) and self.most:
            free = np.searchsorted(times, self.held + self.micros)
            found = np.maximum(np.maximum.accumulate(free - step), at) + step
            found = found[found < len(times)]
            admitted[found] = True
            self.held = np.concatenate([self.held[len(found) :], times[found]])
            at = found[-1] + 1 if len(found) == self.most else len(times)
        return admitted


def with_bursts(hits: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Cut each key's hits where a full window passes without any.

    Nothing admitted before such a gap can matter after it, so bursts are
    independent. Gaps are found on one row per window-long cell, not on the hits.
    ``hits`` has key, ts (timestamp) and id.
    """
    micros = int(window_seconds * 1_000_000)
    celled = hits.withColumn("_t", F.unix_micros("ts")).withColumn(
        "cell", F.floor(F.col("_t") / micros)
    )
    cells = celled.groupBy("key", "cell").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    order = Window.partitionBy("key").orderBy("cell")
    gap = F.col("lo") - F.lag("hi").over(order) >= micros
    starts = cells.withColumn("_new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    bursts = starts.select("key", "cell", F.sum("_new").over(order).alias("burst"))
    return lookup(celled, bursts, ["key", "cell"]).drop("cell")


def admit(
    hits: DataFrame, max_hits: int = MAX_HITS, window_seconds: float = WINDOW_SECONDS
) -> DataFrame:
    """Add ``admitted``: fewer than ``max_hits`` admitted hits lie in the window before.

    Rejected hits do not count, so each decision needs the ones before it. A burst
    is read in time order as a stream of Arrow batches; the state is the last
    ``max_hits`` admitted times, whatever the length of the burst, and the work in a
    batch grows with what is admitted, not with what comes in.
    """
    micros = int(window_seconds * 1_000_000)
    columns = [f.name for f in hits.schema.fields]
    ordered = (
        with_bursts(hits, window_seconds)
        .repartition("key", "burst")
        .sortWithinPartitions("key", "burst", "_t", "id")
    )
    schema = T.StructType([*hits.schema.fields, T.StructField("admitted", T.BooleanType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limit = None, None
        for batch in batches:
            times, verdicts = batch["_t"].to_numpy(), np.zeros(len(batch), bool)
            moved = (batch[["key", "burst"]] != batch[["key", "burst"]].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(moved)
            for low, high in zip(starts, [*starts[1:], len(batch)]):
                place = (batch["key"].iat[low], batch["burst"].iat[low])
                if place != current:
                    current, limit = place, Limit(max_hits, micros)
                verdicts[low:high] = limit.admits(times[low:high])
            yield batch[columns].assign(admitted=verdicts)

    return ordered.mapInPandas(decide, schema)


def running(searches: DataFrame, cap: int = MAX_RUNNING) -> DataFrame:
    """Searches now running, and whether another may start."""
    return searches.agg(F.count_if(F.col("status") == "running").alias("running")).withColumn(
        "may_start", F.col("running") < cap
    )
