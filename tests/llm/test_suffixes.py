import hashlib

import numpy as np

from resultloom.llm.suffixes import Family, dedup_bytes

TESTDATA = "/root/testdata/sf0.001"


def brute(rows, length=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            key = b[k : k + length]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 2, dtype=int)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k + 1 : k + 1 + length] = 1
        spans = int((np.diff(gone) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs, **kw):
    rows = dedup_bytes(docs, digest=True, **kw).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept) for r in rows)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] > 0 for r in want) > 5
    assert found(docs) == want
    assert found(docs, buckets=3, batch=1000) == want


def test_odd_rows(spark):
    passage = "eine Stelle über fünfzig Zeichen, die in mehreren Texten steht. "
    long = "".join(f"{i * 7919 % 10007} " for i in range(30000))
    rows = [(3, None), (4, ""), (5, "a" * 300), (6, "b" + "a" * 49), (7, "xa" + "a" * 60 + "y"), (8, "x" + passage), (9, passage + "z" + passage),
            (9, passage + "z" + passage), (9, "q" + passage[:-1]), (10, long), (11, "é" + long[1000:1100] + "é"), (12, "c" * 49), (13, "c" * 49), (14, "\0" * 80), (15, "d" + "\0" * 60)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id int, text string, keys string")
    assert found(docs) == brute(rows)
    assert found(docs, buckets=2, batch=7) == brute(rows)
    none = spark.createDataFrame([(None, passage), (1, passage)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in dedup_bytes(none).collect()}
    assert got == {1: (0, passage.encode()), None: (len(passage.encode()), b"")}
    assert dedup_bytes(docs.limit(0)).collect() == []


def test_levels_grow_geometrically():
    rng, family = np.random.default_rng(1), Family(50)
    seen, strings = set(), 0
    for doc in range(40):
        data = rng.integers(0, 2, 300).astype(np.uint8)
        if doc % 3 == 0:
            data[:100] = 1
        at = np.arange(len(data) - 49)
        got = family.add(data, at, np.full(len(at), doc))
        keys = [data[k : k + 50].tobytes() for k in at]
        assert got.tolist() == [k in seen for k in keys]
        seen.update(keys)
        strings += len(at)
    sizes = [len(x) for x in family.levels]
    assert len(sizes) < 8 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
