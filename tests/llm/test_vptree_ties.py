import numpy as np
from pyspark.sql import functions as F
from test_vptree import brute, same

from resultloom.llm.vptree import nearest


def check(spark, values, k=20, **sizes):
    rows = [(i + 1, [float(x) for x in v]) for i, v in enumerate(values)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(nearest(vectors, F.col("vec_id") % 20 == 0, k=k, **sizes).collect(), brute(rows, k))


def test_ties_between_distinct_vectors(spark):
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (1200, 16))
    check(spark, bits, leaf_rows=16, shard_rows=300, block_queries=17)
    check(spark, np.eye(90)[rng.permutation(90)], k=5, leaf_rows=4)
    check(spark, rng.integers(-2, 3, (500, 6)) / 4, k=7, leaf_rows=8, shard_rows=200)


def test_one_vector_of_very_large_norm(spark):
    rng = np.random.default_rng(8)
    for far in (1e6, 1e9):
        values = rng.integers(-40, 40, (400, 5)) / 16
        values[17] = 0
        values[17, 2] = far
        check(spark, values, k=6, leaf_rows=8, shard_rows=150)
