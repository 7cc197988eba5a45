import math
import re
import zlib
from collections import Counter

import pytest

from resultloom.llm import lm
from resultloom.llm.bindings import op1_lm_scores

TESTDATA = "/root/testdata/sf0.001"


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def brute(train, rows):
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return n, sorted(out, key=repr)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}
    n, want = brute([d.text for d in docs if not held[d.doc_id]], [(d.doc_id, d.text) for d in docs])
    got = sorted(op1_lm_scores(spark, TESTDATA).collect(), key=lambda r: repr((r.doc_id, r.n_tokens)))
    for r, (i, n_tokens, n_known, base) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (i, n_tokens, n_known, n, held[i])
        assert r.base_score == pytest.approx(base)
        assert r.score <= 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_rounds_and_rare_tokens_change_nothing(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text")
    model = lm.train(docs, buckets=16)
    plain = sorted(map(tuple, lm.score(docs, model).collect()))
    cut = sorted(map(tuple, lm.score(docs, model, filter_bytes=model.filter_bytes // 3, frequent=50).collect()))
    for a, b in zip(plain, cut, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_levels_are_quantised_counts(spark):
    texts = ["a b " * 40, "a c", "a d d d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import numpy as np
    import pyarrow as pa

    model = lm.train(docs, buckets=8, bits_per_entry=64)
    filters = [lm.Filter(*x, model.probes) for x in lm._gathered(model, model.table)]
    levels = lm._probe(pa.array(["a b c d x"]), filters, 2, 8)
    assert levels[0].tolist() == [1 + int(math.log2(c)) for c in (42, 40, 1, 3)] + [0, 2]
    assert levels[1].tolist()[:2] == [2, 6] and levels[1].tolist()[2:] == [0, 0, 0, 0]
    assert np.all(lm.quantised(np.array([1, 2, 4, 8, 1000]), 2.0) == [1, 2, 3, 4, 10])


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "x " * 20000), (None, "É é X x"), (None, "É é X x"), (4, " \t\n")]
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, hash string, n int")
    n, want = brute([t for _, t in rows], rows)
    model = lm.train(docs)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in lm.score(docs, model).collect()), key=repr)
    assert model.total == n
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    empty = docs.limit(0)
    assert lm.score(empty, lm.train(empty)).collect() == []
    assert [r.n_known for r in lm.score(docs.limit(2), lm.train(empty)).collect()] == [0, 0]
