import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from resultloom.llm.bindings import op13_hard_negatives
from resultloom.llm.negatives import LAST, NONE, Heaps, hard_negatives, strassen

TESTDATA = "/root/testdata/sf0.001"


def brute(rows, anchor, positives=5, negatives=10):
    good = {}
    for i, label, v in rows:
        if i is None or label is None or not v or None in v or not np.isfinite(v).all():
            continue
        x = tuple(math.floor(256 * float(c)) for c in v)
        # Of rows with one id the least by bytes of the vector, then label.
        key = (np.array(x, np.int64).tobytes(), len(x), label)
        if i not in good or key < good[i][0]:
            good[i] = (key, label, x)
    out = []
    for a in sorted(i for i in good if anchor(i)):
        _, label, x = good[a]
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, m) for i, (_, m, y) in good.items() if i != a and len(y) == len(x))
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            window = [(i, -s) for s, i, m in scored if m != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, positive, n + 1, i, -p, s) for n, (i, s) in enumerate(window)]
    return sorted(out)


def got(frame):
    assert frame.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, frame.collect()))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{TESTDATA}/embeddings.parquet").collect()
    moved = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    want = brute(moved, lambda i: i % 100 == 0)
    assert want and got(op13_hard_negatives(spark, TESTDATA)) == want


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, size int, bucket int")


@pytest.mark.parametrize("chunk_rows, block_rows, tile_rows", [(7, 3, 2), (64, 4, 256), (1000, 1000, 256)])
def test_chunks_blocks_tiles_and_a_hot_label(spark, chunk_rows, block_rows, tile_rows):
    rng = np.random.default_rng(chunk_rows)
    # Coarse vectors, so that scores tie; a third of the rows has one label.
    rows = [(i, 0 if i % 3 == 0 else int(rng.integers(1, 9)), (rng.integers(0, 3, 5) / 256).tolist()) for i in range(300)]
    found = hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, chunk_rows=chunk_rows, block_rows=block_rows, tile_rows=tile_rows)
    assert got(found) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (10, None, [1.0, 1.0]), (20, 1, None), (30, 1, [1.0, None]), (40, 1, [float("nan"), 1.0]), (50, 1, []), (None, 1, [1.0, 1.0]),
            (1, 1, [0.9, 0.5]), (2, 1, [-1.0, -1.0]), (3, 2, [0.5, 0.3]), (3, 2, [0.5, 0.3]), (4, 3, [0.6, 0.2]), (5, 2, [1.0, 2.0, 3.0]), (60, 2, [1.0, 2.0, 3.0]),
            (7, 1, [0.1, 0.5, 0.5]), (8, 2, [0.0, 0.0]), (70, 5, [0.3, 0.3]), (80, 2, [0.1, 0.1]), (80, 4, [0.1, 0.1]), (9, 4, [1.0, 0.0]), (11, 4, [0.3, 0.4])]
    want = brute(rows, lambda i: i % 10 == 0)
    assert got(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == want
    assert got(hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0)) == []
    # A positive of score zero has a window of zero only, one below zero has none.
    flat = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [-1.0, 0.0]), (3, 2, [0.0, 2.0]), (4, 2, [-0.5, 0.0])]
    assert got(hard_negatives(frame(spark, flat), F.col("vec_id") == 0)) == [(0, 1, 1, 3, 0, 0)]


def test_scores_no_long_can_hold_are_refused(spark):
    rows = frame(spark, [(0, 1, [1e12, 0.0]), (1, 1, [1.0, 1.0])])
    with pytest.raises(Exception, match="do not fit a long"):
        hard_negatives(rows, F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (33, 70, 129), (200, 33, 65), (0, 5, 3), (5, 3, 0)])
def test_strassen_is_the_plain_product(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, c = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (n, k))
    for leaf in (1, 4, 32):
        assert np.array_equal(strassen(a, c, leaf), a @ c.T)


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(9)
    parts = [(rng.integers(-3, 3, (4, 2, 5)), rng.integers(0, 1000, (4, 2, 5))) for _ in range(6)]
    heaps = [Heaps((4, 2), 3) for _ in range(2)]
    for heap, order in zip(heaps, (parts, parts[::-1])):
        for scores, ids in order:
            heap.merge(slice(None), scores, ids)
    assert np.array_equal(heaps[0].scores, heaps[1].scores) and np.array_equal(heaps[0].ids, heaps[1].ids)
    both = sorted((-s, i) for scores, ids in parts for s, i in zip(scores[0, 0], ids[0, 0]))[:3]
    assert [(-s, i) for s, i in zip(heaps[0].scores[0, 0], heaps[0].ids[0, 0])] == both
    empty = Heaps((1,), 2)
    assert (empty.scores == NONE).all() and (empty.ids == LAST).all()
