import hashlib
import re

from resultloom.llm.substrings import dedup_substrings

TESTDATA = "/root/testdata/sf0.001"


def brute(rows, window=13):
    """The stated result from plain Python: sets of word tuples."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(docs, **kw):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup_substrings(docs, digest=True, **kw).collect())


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[2] for r in want)
    assert found(docs) == want
    assert found(docs, buckets=64) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i % 50}" for i in range(5000))
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [
        (3, None), (4, ""), (5, " \t\n"), (6, long), (7, "x " + shared + "\ny"), (8, shared + " z"),
        (8, shared + " z"), (9, shared.replace("s3 ", "s3 ")), (1, " ".join(["a"] * 30)), (2, " ".join(["a"] * 13)),
    ]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id int, text string, hashes string, key int")
    assert found(docs, buckets=3) == brute(rows)
    none = spark.createDataFrame([(None, shared), (1, shared)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_substrings(none).collect()} == {1: 0, None: 20}
    assert dedup_substrings(docs.limit(0)).collect() == []


def test_spans_and_words(spark):
    a = " ".join(f"s{i}" for i in range(15))
    docs = spark.createDataFrame([(1, a), (2, f"p {a} q")], "doc_id long, text string")
    row = [r for r in dedup_substrings(docs).collect() if r.doc_id == 2][0]
    assert row.kept == "p q" and [(s.start, s.stop) for s in row.spans] == [(1, 16)]
