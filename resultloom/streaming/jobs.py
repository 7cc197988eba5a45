"""Searches that are still arriving."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from resultloom.functions.urls import canonical_url, dedupe_key
from resultloom.operators.admission import MAX_HITS, WINDOW_SECONDS, Limit
from resultloom.plans.postpass import finish
from resultloom.schema import LANDING
from resultloom.sources.sinks import read_searches
from resultloom.sources.payloads import DEADLINE_MS, SOURCES, Registry, normalise

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LANDING).parquet(folder)


def progressive_results(landing: DataFrame, registry: Registry = SOURCES) -> DataFrame:
    """Records as each source's payload lands, before its search is complete."""
    return normalise(landing, registry)


def first_seen(results: DataFrame, remember: str = "30 days") -> DataFrame:
    """The first record of each page of a search to come in; a side table, the records all stay.

    A page is remembered for ``remember`` after it came in, on the clock: the watermark is that of arrival, which
    no record is behind, so a page first seen with an old ``retrieved_at`` has its row too.
    """
    keyed = results.withColumn("dedupe_key", dedupe_key(canonical_url(F.col("url"))))
    return (
        keyed.withColumn("seen_at", F.current_timestamp())
        .withWatermark("seen_at", remember)
        .dropDuplicatesWithinWatermark(["search_id", "dedupe_key"])
        .select("search_id", "dedupe_key", "id", "retrieved_at")
    )


class _Throttle(StatefulProcessor):
    """Keeps the admitted times of one key that still count."""

    def __init__(self, max_hits: int, window_seconds: float) -> None:
        self._max = max_hits
        self._micros = int(window_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("t", T.LongType())])
        self._admitted = handle.getListState("admitted", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        held = [row[0] for row in self._admitted.get()] if self._admitted.exists() else []
        limit = Limit(self._max, self._micros, held)
        verdicts = limit.admits(hits["t"].to_numpy())
        self._admitted.put([(int(t),) for t in limit.held])
        yield pd.DataFrame({"key": key[0], "id": hits["id"].to_numpy(), "admitted": verdicts})

    def close(self) -> None:
        pass


def throttle(
    hits: DataFrame, max_hits: int = MAX_HITS, window_seconds: float = WINDOW_SECONDS
) -> DataFrame:
    """Admission decisions for a stream of hits (key, ts, id)."""
    use_rocksdb(hits.sparkSession)
    schema = T.StructType(
        [
            T.StructField("key", hits.schema["key"].dataType),
            T.StructField("id", hits.schema["id"].dataType),
            T.StructField("admitted", T.BooleanType()),
        ]
    )
    timed = hits.select("key", F.unix_micros("ts").alias("t"), "id")
    return timed.groupBy("key").transformWithStateInPandas(
        _Throttle(max_hits, window_seconds), schema, "append", "none"
    )


# How long a closed wait is remembered, to ignore what still comes for it.
REMEMBER_MS = 24 * 3_600_000

# Into how many states the waits are dealt. A batch reads and writes whole states: some ms for each it has signals for, and
# 2 or 3 us for each wait that one remembers. A stream that remembers tens of millions should have more.
BUCKETS = 4096


class _Deadline(StatefulProcessor):
    """Waits for one source of one search until its deadline passes on the clock.

    Each call of the state costs more than what is done with it, so all that is known of a key is one
    value, read once and written once: the first start, the first answer, the timer that is set, or that the wait is closed.
    """

    def __init__(self, deadline_ms: int, remember_ms: int) -> None:
        self._deadline, self._remember = deadline_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "start long, expected long, answer long, status string, timer long")
        self._closed = handle.getValueState("closed", "yes boolean", self._remember)

    def _close(self, key, start: int, expected: int | None, status: str, latency: int) -> Row:
        self._closed.update((True,))
        return Row(search_id=key[0], source=key[1], status=status, latency_ms=latency, at_ms=start + latency, expected=expected)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self._closed.get() is not None:
            return
        known = self._open.get()
        start, expected, answer, status, timer = known or (None,) * 5
        starts = [] if start is None else [(start, expected)]
        answers = [] if answer is None else [(answer, status)]
        for row in rows:
            if row["status"] == "started":
                starts.append((row["at_ms"], row["expected"]))
            else:
                answers.append((row["at_ms"], row["status"]))
        # Only the first of each counts. An answer may come before its start: it is kept, however old it is.
        start, expected = min(starts, key=lambda s: (s[0], s[1] or 0), default=(None, None))
        answer, status = min(answers, default=(None, None))
        if starts and answers:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if known:
                self._open.clear()
            late = answer - start > self._deadline
            yield self._close(key, start, expected, "timeout" if late else status, self._deadline if late else answer - start)
            return
        if starts and timer is None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self._deadline
            self._handle.registerTimer(timer)
        self._open.update((start, expected, answer, status, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._open.get()
        if known is not None:
            self._open.clear()
            yield self._close(key, known[0], known[1], "timeout", self._deadline)

    def close(self) -> None:
        pass


# Stands for no ``expected``, so that the column has no nulls and its numbers stay whole in pandas.
UNSAID = -(2**63)


def _json(value: list) -> str:
    return json.dumps(value, separators=(",", ":"))


class _Deadlines(StatefulProcessor):
    """All waits of a bucket, each by the rule of ``_Deadline``.

    A call of the state costs as much as what is done with hundreds of signals, so the open waits are one value,
    read and written once for all signals of a batch, and those closed another. A wait is known by its search and source in full.
    """

    def __init__(self, deadline_ms: int, remember_ms: int) -> None:
        self._deadline, self._remember = deadline_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # JSON. Open: [search, source, first start, expected, first answer, status, timer] of each. Closed: [closed at, how many]
        # of each batch, oldest first, and in that order their searches and their sources.
        self._open = handle.getValueState("open", "waits string")
        self._closed = handle.getValueState("closed", "waits string", self._remember)

    def _waits(self) -> dict[tuple, list]:
        held = self._open.get()
        return {(search, source): known for search, source, *known in (json.loads(held[0]) if held else [])}

    def _keep(self, waits: dict[tuple, list]) -> None:
        if waits:
            self._open.update((_json([[*wait, *known] for wait, known in waits.items()]),))
        else:
            self._open.clear()

    def _remembered(self, now: int) -> tuple[list, list, list]:
        held = self._closed.get()
        batches, searches, sources = json.loads(held[0]) if held else ([], [], [])
        over = 0
        while batches and batches[0][0] + self._remember <= now:
            over += batches.pop(0)[1]
        return batches, searches[over:], sources[over:]

    def _close(self, remembered: tuple[list, list, list], told: list[tuple], now: int) -> pd.DataFrame:
        batches, searches, sources = remembered
        batches.append([now, len(told)])
        searches += [row[0] for row in told]
        sources += [row[1] for row in told]
        self._closed.update((_json([batches, searches, sources]),))
        # Objects, so that numbers beside nulls stay whole.
        return pd.DataFrame(told, columns=OUTCOME.names, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        remembered = self._remembered(now)
        closed = set(zip(*remembered[1:]))
        waits = self._waits()
        held, timers, fresh = bool(waits), {known[4] for known in waits.values()}, False
        for signals in rows:
            columns = (signals[name].tolist() for name in ("search_id", "source", "status", "at_ms", "expected"))
            for search, source, status, at, expected in zip(*columns):
                if (search, source) in closed:
                    continue
                fresh, at = True, int(at)
                known = waits.setdefault((search, source), [None] * 5)
                # Only the first of each counts. An answer may come before its start: it is kept, however old it is.
                if status == "started":
                    expected = None if expected == UNSAID else expected
                    if known[0] is None or (at, expected or 0) < (known[0], known[1] or 0):
                        known[:2] = at, expected
                elif known[2] is None or (at, status) < (known[2], known[3]):
                    known[2:4] = at, status
        if not fresh:
            return
        told = []
        for wait, known in list(waits.items()):
            start, expected, answer, status, timer = known
            if start is not None and answer is not None:
                late = answer - start > self._deadline
                latency = self._deadline if late else answer - start
                told.append((*wait, "timeout" if late else status, latency, start + latency, expected))
                del waits[wait]
            elif start is not None and timer is None:
                known[4] = now + self._deadline
        if waits or held:
            self._keep(waits)
        kept = {known[4] for known in waits.values()}
        for timer in kept - timers - {None}:
            self._handle.registerTimer(timer)
        for timer in timers - kept - {None}:
            self._handle.deleteTimer(timer)
        if told:
            yield self._close(remembered, told, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, expiry = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        waits, told = self._waits(), []
        for wait, (start, expected, _, _, timer) in list(waits.items()):
            if timer is not None and timer <= expiry:
                told.append((*wait, "timeout", self._deadline, start + self._deadline, expected))
                del waits[wait]
        if told:
            self._keep(waits)
            yield self._close(self._remembered(now), told, now)

    def close(self) -> None:
        pass


OUTCOME = T.StructType(
    [
        T.StructField("search_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("at_ms", T.LongType()),
        T.StructField("expected", T.LongType()),
    ]
)


def enforce_deadline(
    signals: DataFrame, deadline_ms: int = DEADLINE_MS, remember_ms: int = REMEMBER_MS, buckets: int | None = BUCKETS
) -> DataFrame:
    """One outcome per (search, source) from signals (search_id, source, status, at).

    A ``started`` signal opens the wait; the first answer closes it, as a timeout if its time is
    past the deadline. A source that stays silent times out by the clock, when the deadline has
    passed since its start came in. No signal is too late or too early to count, and other sources
    are not held up. Closed waits are forgotten after ``remember_ms``.

    The outcome has search_id, source, status, latency_ms, the time ``at`` the wait closed, and
    ``expected``: how many sources the search asks, as its starts say where they have that column.

    Waits are dealt into so many ``buckets``, each with one state; with None each wait has its own, which costs some ms a
    wait and suits a stream of few signals. The number must stay as it is for the life of a checkpoint.
    """
    use_rocksdb(signals.sparkSession)
    expected = F.col("expected").cast("long") if "expected" in signals.columns else F.lit(None).cast("long")
    timed = signals.select("search_id", "source", "status", F.unix_millis("at").alias("at_ms"), expected.alias("expected"))
    if buckets:
        bucket = F.pmod(F.xxhash64("search_id", "source"), F.lit(buckets)).alias("bucket")
        dealt = timed.withColumn("expected", F.coalesce("expected", F.lit(UNSAID))).select(bucket, "*")
        outcomes = dealt.groupBy("bucket").transformWithStateInPandas(
            _Deadlines(deadline_ms, remember_ms), OUTCOME, "append", "ProcessingTime"
        )
    else:
        outcomes = timed.groupBy("search_id", "source").transformWithState(
            _Deadline(deadline_ms, remember_ms), OUTCOME, "append", "ProcessingTime"
        )
    return outcomes.withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms")


class _Completion(StatefulProcessor):
    """Counts the sources of one search that have an outcome."""

    def __init__(self, expected: int | None, remember_ms: int) -> None:
        self._expected, self._remember = expected, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._outcomes = handle.getMapState("outcomes", "source string", "status string", self._remember)
        self._asked = handle.getValueState("asked", "sources long", self._remember)
        self._done = handle.getValueState("done", "yes boolean", self._remember)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self._done.exists():
            return
        known = {k[0]: v[0] for k, v in self._outcomes.iterator()}
        asked = self._asked.get()[0] if self._asked.exists() else self._expected
        # Of two outcomes of a source in one batch the first counts, in whatever order they come.
        first: dict[str, tuple] = {}
        for seen in rows:
            for row in seen[["source", "at", "status", "expected"]].itertuples(index=False, name=None):
                first[row[0]] = min(first.get(row[0], row[1:3]), row[1:3])
                if self._expected is None and not pd.isna(row[3]):
                    asked = max(int(row[3]), asked or 0)
        fresh = {source: status for source, (_, status) in first.items() if source not in known}
        known.update(fresh)
        if asked is None or len(known) < asked:
            for source, status in fresh.items():
                self._outcomes.updateValue((source,), (status,))
            if asked is not None:
                self._asked.update((asked,))
            return
        # Of a completed search only that is kept, for a time.
        self._outcomes.clear()
        self._asked.clear()
        self._done.update((True,))
        failed = sum(status != "success" for status in known.values())
        state = "completed" if not failed else "partial" if failed < len(known) else "failed"
        yield pd.DataFrame({"search_id": [key[0]], "status": [state], "failed": [failed]})

    def close(self) -> None:
        pass


def completions(outcomes: DataFrame, expected: int | None = None, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """A row for each search once all its sources have an outcome.

    ``outcomes`` has search_id, source, status and ``at``, which orders them. How many sources a
    search has is ``expected``, or else what the column of that name says on its outcomes; a
    search of which no row says it does not complete. It may follow ``enforce_deadline`` in one query. State of a
    search is forgotten ``remember_ms`` after it last changed, completed or not.
    """
    use_rocksdb(outcomes.sparkSession)
    asked = F.col("expected").cast("long") if "expected" in outcomes.columns else F.lit(None).cast("long")
    return outcomes.select("search_id", "source", "status", "at", asked.alias("expected")).groupBy("search_id").transformWithStateInPandas(
        _Completion(expected, remember_ms), "search_id string, status string, failed long", "append", "ProcessingTime"
    )


def postpass_batch(
    results_path: str, searches: DataFrame, output_path: str, now: Callable[[], datetime], buckets: int = 512
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: link and rank the searches that completed in the batch.

    ``results_path`` was written by ``append_results`` with as many ``buckets``. Ranked rows, groups and
    the states of the searches go to folders of the batch, overwritten when the batch is retried.
    """

    def step(completed: DataFrame, batch_id: int) -> None:
        spark = completed.sparkSession
        if completed.isEmpty():
            return
        ids = completed.select("search_id").distinct()
        rows = read_searches(spark.read.parquet(results_path), ids, buckets).drop("bucket")
        ranked, groups = finish(rows, searches.join(ids, "search_id", "left_semi"), now())
        ranked.write.mode("overwrite").parquet(f"{output_path}/results/batch={batch_id}")
        groups.write.mode("overwrite").parquet(f"{output_path}/groups/batch={batch_id}")
        completed.write.mode("overwrite").parquet(f"{output_path}/searches/batch={batch_id}")

    return step


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there now into ``path`` and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def pending_timers(spark: SparkSession, checkpoint: str, operators: int) -> int:
    """Timers that the stateful operators of a query still wait for, as of its last batch."""
    total = 0
    for number in range(operators):
        state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", number)
        total += state.option("readRegisteredTimers", True).load().count()
    return total


def run_until_settled(
    stream: DataFrame, checkpoint: str, path: str | None = None, step: Callable[[DataFrame, int], None] | None = None
) -> DataFrame | None:
    """Process what is there now, and go on until no timer is pending that could still give a row.

    For jobs with timers on the clock, which have work as long as they run: the end depends on
    their state, so it holds after a restart and for any deadline. Rows go to ``path``, which is
    read back, or to ``step`` batch by batch.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds")
    query = (writer.foreachBatch(step) if step else writer.format("parquet").option("path", path)).start()
    checked = None
    try:
        while query.isActive:
            done = query.lastProgress
            if done and not done["numInputRows"] and done["batchId"] != checked:
                checked = done["batchId"]
                if not pending_timers(spark, checkpoint, len(done["stateOperators"])):
                    break
            time.sleep(0.1)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return None if step else spark.read.schema(stream.schema).parquet(path)
