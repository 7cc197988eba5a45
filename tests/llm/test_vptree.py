import numpy as np
import pytest
from pyspark.sql import functions as F

from resultloom.llm.bindings import op7_nearest
from resultloom.llm.vptree import Search, VPTree, nearest

TESTDATA = "/root/testdata/sf0.001"


def brute(rows, k=20):
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and None not in v}
    good = {i: v for i, v in good.items() if np.isfinite(v).all() and v.any()}
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        scored = sorted((-float((v * good[q]).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def same(got, want):
    got = sorted(map(tuple, got))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-12)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{TESTDATA}/embeddings.parquet").collect()
    same(op7_nearest(spark, TESTDATA).collect(), brute([(r.vec_id, r.embedding) for r in rows]))


def test_shards_blocks_and_leaves(spark):
    vectors = spark.read.parquet(f"{TESTDATA}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 5)
    got = nearest(vectors, F.col("vec_id") % 20 == 0, k=5, shard_rows=60, block_queries=7, leaf_rows=4)
    same(got.collect(), want)
    near = nearest(vectors, F.col("vec_id") % 20 == 0, k=5, shard_rows=250, leaf_rows=4, relax=1.5).collect()
    exact = {(r[0], r[2]) for r in want}
    assert len({(r.query_id, r.vec_id) for r in near} & exact) >= 0.9 * len(exact)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (1, [float("inf"), 1.0]), (2, []),
            (3, [3.0, -1.0]), (4, [0.5, 0.5]), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0])]
    rows += [(i, [5.0, 5.0]) for i in range(201, 260) if i % 20]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, shard int")
    same(nearest(vectors, F.col("vec_id") % 20 == 0, leaf_rows=1).collect(), brute(rows))
    assert nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = vectors.filter("vec_id in (0, 3, 4)")
    same(nearest(few, F.col("vec_id") % 20 == 0).collect(), brute(rows[:1] + rows[7:9]))


def test_pruning_skips_and_stays_exact():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4000, 3))
    queries = rng.normal(size=(50, 3))
    tree = VPTree(points, 16)
    exact = Search(tree, points, queries, 10, 1.0)
    want = np.sort(np.sqrt(((queries[:, None] - points) ** 2).sum(axis=2)), axis=1)[:, :10]
    assert np.allclose(np.sort(exact.best, axis=1), want)
    relaxed = Search(tree, points, queries, 10, 2.0)
    assert relaxed.compared < exact.compared < 50 * 4000
