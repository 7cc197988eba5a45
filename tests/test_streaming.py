import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from resultloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def put(spark, folder, rows):
    """One file of signals: search, source, status, seconds after the start of the day."""
    data = [(s, src, status, T0 + dt.timedelta(seconds=at)) for s, src, status, at in rows]
    spark.createDataFrame(data, "search_id string, source string, status string, at timestamp").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("order", [1, -1])
def test_no_signal_is_lost(spark, tmp_path, order):
    """Starts and answers in separate files, in either order of time, and sources that stay silent."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, [("warm", "a", "started", 0), ("warm", "a", "success", 1)])
    schema = spark.read.parquet(folder).schema
    stream = jobs.enforce_deadline(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder), deadline_ms=4500)
    files = [
        [("A", "a", "success", 2), ("B", "a", "started", 60), ("B", "a", "failed", 61)],
        [("A", "a", "started", 0), ("D", "a", "started", 30), ("D", "a", "success", 31), ("C", "a", "started", 120), ("L", "b", "started", 0)],
        [("L", "b", "success", 9), ("B", "a", "success", 60.5), ("D", "b", "started", 1)],
    ]
    for rows in files[::order]:
        put(spark, folder, rows)
    found = jobs.run_until_settled(stream, str(tmp_path / "check"), out)
    got = {(r.search_id, r.source): (r.status, r.latency_ms) for r in found.collect()}
    want = {("warm", "a"): ("success", 1000), ("A", "a"): ("success", 2000), ("D", "a"): ("success", 1000),
            ("C", "a"): ("timeout", 4500), ("L", "b"): ("timeout", 4500), ("D", "b"): ("timeout", 4500)}
    # B has two answers: the first to be seen with the start closes it.
    assert got.pop(("B", "a"))[0] in ("failed", "success")
    assert got == want
    assert found.count() == 7


def test_completion_is_told_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("s", "a", "success", 0), ("s", "b", "timeout", 0), ("q", "a", "failed", 0), ("q", "a", "success", 1)])
    put(spark, folder, [("s", "a", "failed", 5), ("q", "b", "failed", 1)])
    schema = spark.read.parquet(folder).schema
    done = jobs.completions(spark.readStream.schema(schema).parquet(folder), 2)
    rows = jobs.run_until_settled(done, str(tmp_path / "check"), str(tmp_path / "out")).collect()
    # The first outcome of a source counts: s has a success and a timeout, q two failures.
    assert sorted((r.search_id, r.status, r.failed) for r in rows) == [("q", "failed", 2), ("s", "partial", 1)]


def test_completed_searches_are_ranked_from_the_store(spark, tmp_path):
    from resultloom.bindings.tables import NOW, Tables
    from resultloom.operators.views import page_of
    from resultloom.sources.sinks import append_results

    t = Tables(spark, "/root/testdata/sf0.001")
    store, out = str(tmp_path / "store"), str(tmp_path / "ranked")
    append_results(t.results().drop("doc_id"), store, buckets=4)
    step = jobs.postpass_batch(store, t.searches(), out, lambda: NOW, buckets=4)
    done = spark.createDataFrame([("s1", "completed"), ("s2", "partial")], "search_id string, status string")
    for _ in range(2):
        step(done, 7)
    ranked = spark.read.parquet(f"{out}/results/batch=7")
    want = {r.search_id: r.n for r in t.results().filter("search_id in ('s1', 's2')").groupBy("search_id").agg(F.count("*").alias("n")).collect()}
    got = {r.search_id: (r.n, r.last) for r in ranked.groupBy("search_id").agg(F.count("*").alias("n"), F.max("rank_position").alias("last")).collect()}
    assert {k: n for k, (n, _) in got.items()} == want and all(last == n - 1 for n, last in got.values())
    pages = [[r.id for r in page_of(ranked, "s1", page, 2).collect()] for page in (1, 2, 99)]
    order = [r.id for r in ranked.filter("search_id = 's1'").orderBy("rank_position").collect()]
    assert pages == [order[:2], order[2:4], []]


def test_a_wait_reads_and_writes_its_state_once():
    calls = []

    class Value:
        def __init__(self, name):
            self.name, self.held = name, None

        def get(self):
            calls.append((self.name, "get"))
            return self.held

        def update(self, value):
            calls.append((self.name, "update"))
            self.held = value

        def clear(self):
            calls.append((self.name, "clear"))
            self.held = None

    class Handle:
        timers = set()

        def getValueState(self, name, schema, ttl=None):
            return Value(name)

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 10

    signal = lambda status, at: {"status": status, "at_ms": at, "expected": None}
    told = lambda wait, *rows: [tuple(r) for r in wait.handleInputRows(("s", "a"), iter(rows), Clock())]
    wait = jobs._Deadline(4500, 1000)
    wait.init(Handle())
    assert told(wait, signal("success", 900), signal("started", 0), signal("failed", 950)) == [("s", "a", "success", 900, 900, None)]
    assert len(calls) == 3 and told(wait, signal("started", 1)) == []
    late = jobs._Deadline(4500, 1000)
    late.init(Handle())
    assert told(late, signal("started", 5)) == [] and Handle.timers == {4510}
    assert told(late, signal("success", 5000)) == [("s", "a", "timeout", 4500, 4505, None)] and not Handle.timers
    silent = jobs._Deadline(4500, 1000)
    silent.init(Handle())
    told(silent, signal("started", 7))
    assert [tuple(r) for r in silent.handleExpiredTimer(("s", "a"), Clock(), None)] == [("s", "a", "timeout", 4500, 4507, None)]
    assert list(silent.handleExpiredTimer(("s", "a"), Clock(), None)) == []


class Store:
    """The state of one key and its timers, with a count of the calls."""

    def __init__(self):
        self.calls, self.timers, self.now = 0, set(), 0

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.expiry

    def getValueState(self, name, schema, ttl=None):
        store, held = self, {}

        class Value:
            def get(self):
                store.calls += 1
                return held["value"] if held and (ttl is None or held["at"] + ttl > store.now) else None

            def update(self, value):
                store.calls += 1
                held.update(value=value, at=store.now)

            def clear(self):
                store.calls += 1
                held.clear()

        return Value()

    def registerTimer(self, at):
        self.calls += 1
        assert at not in self.timers
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def play(made, key_of, frame, batches):
    """Outcomes of a processor by batch, as Spark drives it: rows by key, then the timers that are over."""
    stores, waits, told = {}, {}, []
    for now, signals in batches:
        dealt, outcomes = {}, []
        for row in signals:
            dealt.setdefault(key_of(row), []).append(row)
        for key, rows in dealt.items():
            if key not in stores:
                stores[key], waits[key] = Store(), made()
                waits[key].init(stores[key])
            stores[key].now = now
            outcomes += waits[key].handleInputRows(key, frame(rows), stores[key])
        for key, store in stores.items():
            store.now = now
            for store.expiry in sorted(t for t in store.timers if t <= now):
                if store.expiry in store.timers:
                    outcomes += waits[key].handleExpiredTimer(key, store, store)
                    store.timers.discard(store.expiry)
        told.append(sorted((tuple(r) for o in outcomes for r in (o.itertuples(index=False) if isinstance(o, pd.DataFrame) else [o])), key=repr))
    return told, stores


COLUMNS = ["search_id", "source", "status", "at_ms", "expected"]


def in_frames(rows):
    rows = [(*r[:4], jobs.UNSAID if r[4] is None else r[4]) for r in rows]
    return iter([pd.DataFrame(rows[i : i + 3], columns=COLUMNS) for i in range(0, len(rows), 3)])


@pytest.mark.parametrize("seed", range(20))
def test_waits_of_a_bucket_end_as_each_would_alone(seed):
    rng = random.Random(seed)
    ends, batches, now = {"success", "failed"}, [], 0
    for _ in range(60):
        now += rng.choice([100, 2000, 4500, 9000])
        batches.append((now, [
            (rng.choice(["s1", 's"2', "s\n3", None]), rng.choice(["a", "b,é", "c"]), rng.choice(["started", *sorted(ends)]), now - rng.randrange(0, 6000, 500), rng.choice([None, 0, 3, 2**60 + 1]))
            for _ in range(rng.randrange(8))
        ]))
    batches += [(now + 4500 * (i + 1), []) for i in range(4)]
    alone, _ = play(lambda: jobs._Deadline(4500, 20_000), lambda r: r[:2], lambda rows: iter([dict(zip(COLUMNS, r)) for r in rows]), batches)
    together, stores = play(lambda: jobs._Deadlines(4500, 20_000), lambda r: (0,), in_frames, batches)
    assert together == alone and sum(map(len, alone)) > 20
    assert not any(store.timers for store in stores.values())


def test_state_calls_do_not_grow_with_the_waits_of_a_bucket():
    batches = [
        (1000, [(f"s{i}", "a", status, 500, None) for i in range(3000) for status in ("started", "success")[: 1 + (i % 10 != 3)]]),
        (2000, [(f"s{i}", "a", "success", 600, None) for i in range(3000)]),
        (9000, []),
    ]
    told, stores = play(lambda: jobs._Deadlines(4500, 20_000), lambda r: (0,), in_frames, batches)
    assert [len(rows) for rows in told] == [2700, 300, 0]
    assert sum(store.calls for store in stores.values()) <= 12


@pytest.mark.parametrize("buckets", [1, None])
def test_waits_in_one_bucket_and_in_none(spark, tmp_path, buckets):
    folder = str(tmp_path / "in")
    put(spark, folder, [("A", "a", "started", 0), ("A", "b", "started", 0), ("B", "a", "success", 9)])
    put(spark, folder, [("A", "a", "failed", 2), ("B", "a", "started", 0), ("A", "a", "success", 3)])
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = jobs.run_until_settled(jobs.enforce_deadline(stream, 4500, buckets=buckets), str(tmp_path / "check"), str(tmp_path / "out"))
    got = sorted((r.search_id, r.source, r.status, r.latency_ms, str(r["at"]), r.expected) for r in found.collect())
    assert got == [
        ("A", "a", "failed", 2000, "2024-01-01 00:00:02", None), ("A", "b", "timeout", 4500, "2024-01-01 00:00:04.500000", None),
        ("B", "a", "timeout", 4500, "2024-01-01 00:00:04.500000", None),
    ]
