import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from resultloom.llm.bindings import op12_exact_dedup
from resultloom.llm.exact import drop_copies, mark_copies

TESTDATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def normal(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows):
    groups = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        groups[normal(text)].append((-len(text or ""), i is None, i or 0, n, i))
    out = []
    for text, own in groups.items():
        first = min(own)
        out += [(r[4], first[4], len(own), r[3] == first[3], hashlib.sha256(text.encode()).hexdigest()) for r in own]
    return sorted(out, key=str)


def got(frame):
    assert frame.columns == COLUMNS
    return sorted([tuple(r) for r in frame.collect()], key=str)


ODD = [
    (1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "a\u00a0b"), (8, "AB"), (9, "éé x" * 30_000),
    (10, "éé x" * 30_000), (10, "éé x" * 30_000), (11, "\x00"), (None, "ab"), (None, "x y"), (None, "xy"), (12, "xy"), (13, "ab" * 5), (14, "a b" * 5),
]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()
    assert got(op12_exact_dedup(spark, TESTDATA)) == brute([(r.doc_id, r.text) for r in rows])


def frame(spark, rows):
    extra = [(i, t, "k", -1, "n") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, key string, group_size int, normal string")


def test_odd_rows(spark):
    assert got(mark_copies(frame(spark, ODD))) == brute(ODD)
    assert got(mark_copies(frame(spark, []))) == []


def test_collisions_are_told_apart_by_bytes(spark):
    rows = ODD + [(20 + i, "t" * (i % 7)) for i in range(60)]
    assert got(mark_copies(frame(spark, rows), key=lambda text: F.pmod(F.length(text), F.lit(3)))) == brute(rows)
    assert got(mark_copies(frame(spark, rows), key=lambda text: F.lit(1))) == brute(rows)


def test_kept_rows_keep_their_columns(spark):
    docs = frame(spark, ODD)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    groups = {r[4] for r in brute(ODD)}
    assert len(rows) == len(groups) and set(rows) <= set(ODD)
    keepers = sorted(str(r[0]) for r in brute(ODD) if r[3])
    assert sorted(str(r[0]) for r in rows) == keepers
    # A text under its own rule of what is equal.
    lower = drop_copies(docs, normal=F.lower(F.coalesce("text", F.lit(""))))
    ids = {r.doc_id for r in lower.collect()}
    assert {1, 2, 3} <= ids and 8 not in ids


def test_one_hot_group(spark):
    rows = [(i, "same text again " + " " * (i % 3)) for i in range(3000)] + [(5000 + i, f"own {i}") for i in range(50)]
    assert got(mark_copies(frame(spark, rows))) == brute(rows)


def test_no_python_in_the_plan(spark):
    plan = mark_copies(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
