from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from resultloom.llm.mixing import mix, mixed, source_targets

TESTDATA = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Shares by weight; what is over a source's cap goes to the others, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, fixed = share * sum(sizes.values()), {}, set(s for s in names if not sizes[s])
    target.update(dict.fromkeys(fixed, 0.0))
    while True:
        left = total - sum(target[s] for s in fixed)
        open_weight = sum(weight[s] for s in names if s not in fixed)
        for s in names:
            if s not in fixed:
                target[s] = left * weight[s] / open_weight
        over = [s for s in names if s not in fixed and target[s] > epochs * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = float(epochs * sizes[s])
            fixed.add(s)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 70, "é": 300}, {"x": 7}, {"a": 0, "b": 9}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1, 1.0) for s, n in sizes.items()], "source string, source_size long, rows long, _mean double")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    want = brute_targets(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got == pytest.approx(want)


def test_mix_of_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    rows = mix(docs, slice_rows=7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs).collect())) == sorted(map(tuple, mix(docs.repartition(5), slice_rows=3).collect()))
    assert len(rows) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, largest, size = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        size[s] += r.size
        largest[s] = max(largest[s], r.size)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        # A complete epoch comes before any second copy.
        assert r.copies >= int(r.target // r.source_size)
    for r in rows:
        assert r.source_size == size[source[r.doc_id]]
        assert abs(taken[source[r.doc_id]] - r.target) <= largest[source[r.doc_id]] / 2 + 1
    copies = mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mix_epoch").alias("last")).collect()
    assert {r.doc_id: r.n for r in copies} == {r.doc_id: r.copies for r in rows if r.copies} and all(r.n == r.last for r in copies)


def test_quality_draws(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2).alias("good"))
    done = mix(docs.drop("good"), share=0.3, quality=F.when(F.col("doc_id") % 2 == 1, 4.0).otherwise(1.0), slice_rows=100)
    taken = {r.g: r.n for r in done.groupBy((F.col("doc_id") % 2).alias("g")).agg(F.sum("taken").alias("n")).collect()}
    assert sum(taken.values()) == 2400 and taken[1] > 2.5 * taken[0]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (4, "one two three", None), (4, "one two three", None), (None, "x y", "b"), (5, "w " * 30000, "b"), (6, "q", "")]
    docs = spark.createDataFrame([(i, t, s, 9, "k") for i, t, s in rows], "doc_id long, text string, source string, size int, row string")
    got = mix(docs).collect()
    assert len(got) == len(rows) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert sum(r.taken for r in got if r.doc_id in (1, 2, 3)) == 0
    assert mixed(docs).columns == [*docs.columns, "mix_epoch"]
    assert mix(docs.limit(0)).collect() == [] and mixed(docs.filter("doc_id = 1")).collect() == []
