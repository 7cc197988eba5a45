"""Nearest neighbours by largest inner product, from vantage-point trees per shard."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 20
# Vectors of one tree, and queries that search it at once.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
LEAF_ROWS = 256
# 1 prunes only what cannot hold a neighbour; larger factors prune more.
RELAX = 1.0


class VPTree:
    """A vantage-point tree of rows that are points of a Euclidean space.

    A node has a vantage point, and for its two halves (nearer, farther than the median) the least
    and largest distance to it. A leaf has a range of ``order``.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.order, self.nodes = np.arange(len(points)), []
        self._grow(points, 0, len(points), leaf)

    def _grow(self, points, low: int, high: int, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append((low, high, None, None))
        if high - low <= leaf:
            return number
        own = points[self.order[low:high]]
        # The point farthest from the middle spreads the distances most.
        vantage = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
        distance = np.sqrt(((own - vantage) ** 2).sum(axis=1))
        half = (high - low) // 2
        rank = np.argsort(distance, kind="stable")
        self.order[low:high], distance = self.order[low:high][rank], distance[rank]
        sides = [
            (distance[0], distance[half - 1], self._grow(points, low, low + half, leaf)),
            (distance[half], distance[-1], self._grow(points, low + half, high, leaf)),
        ]
        self.nodes[number] = (low, high, vantage, sides)
        return number


class Search:
    """The ``k`` points nearest to each of many queries, all led through the tree together."""

    def __init__(self, tree: VPTree, points: np.ndarray, queries: np.ndarray, k: int, relax: float) -> None:
        self.tree, self.points, self.queries, self.relax = tree, points, queries, relax
        self.norms = (points**2).sum(axis=1)
        self.own = (queries**2).sum(axis=1)
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), -1)
        self.compared = 0
        if len(points) and len(queries):
            self._visit(0, np.arange(len(queries)))

    def _visit(self, number: int, active: np.ndarray) -> None:
        low, high, vantage, sides = self.tree.nodes[number]
        if not len(active):
            return
        if sides is None:
            self.compared += (high - low) * len(active)
            self._leaf(self.tree.order[low:high], active)
            return
        distance = np.sqrt(((self.queries[active] - vantage) ** 2).sum(axis=1))
        nearer = distance <= (sides[0][1] + sides[1][0]) / 2
        for own, first, second in ((nearer, 0, 1), (~nearer, 1, 0)):
            for side in (first, second):
                least, most, child = sides[side]
                # By the triangle inequality nothing on that side is nearer than this.
                bound = np.maximum(np.maximum(least - distance, distance - most), 0)[own]
                self._visit(child, active[own][self._open(active[own], bound * self.relax)])

    def _open(self, active: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return bound <= self.best[active].max(axis=1) + 1e-9

    def _leaf(self, at: np.ndarray, active: np.ndarray) -> None:
        square = self.own[active, None] + self.norms[at] - 2 * self.queries[active] @ self.points[at].T
        all_best = np.hstack([self.best[active], np.sqrt(np.maximum(square, 0))])
        all_found = np.hstack([self.found[active], np.broadcast_to(at, square.shape)])
        k = self.best.shape[1]
        pick = np.argpartition(all_best, k - 1, axis=1)[:, :k]
        self.best[active] = np.take_along_axis(all_best, pick, axis=1)
        self.found[active] = np.take_along_axis(all_found, pick, axis=1)


class Products(Search):
    """The ``k`` vectors of largest inner product with each query, of equal ones those of least id.

    ``points`` are ``vectors`` with a last coordinate that brings each square to ``top``. They only
    lead through the tree; a leaf chooses by the product of the vectors in doubles. What rounding
    can move, in the distances as in the fast products, is allowed for.
    """

    def __init__(self, tree: VPTree, vectors: np.ndarray, rest: np.ndarray, top: float, ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> None:
        self.vectors, self.asked, self.top, self.ids = vectors, queries, top, ids
        self.lengths, self.reach = np.sqrt((vectors**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
        self.unit = 16 * (vectors.shape[1] + 8) * np.finfo(float).eps
        self.score = np.full((len(queries), k), -np.inf)
        super().__init__(tree, np.column_stack([vectors, rest]), np.column_stack([queries, np.zeros(len(queries))]), k, relax)

    def _open(self, active: np.ndarray, bound: np.ndarray) -> np.ndarray:
        both = self.own[active] + self.top
        # The largest product at that distance; a branch that can tie is open.
        return (both - bound**2) / 2 + self.unit * both >= self.score[active, -1]

    def _leaf(self, at: np.ndarray, active: np.ndarray) -> None:
        k = self.score.shape[1]
        for low in range(0, len(active), 64):
            rows = active[low : low + 64]
            fast = self.asked[rows] @ self.vectors[at].T
            slack = self.unit * self.reach[rows, None] * self.lengths[at]
            least = self.score[rows, -1]
            if len(at) > k:
                least = np.maximum(least, np.partition(fast - slack, len(at) - k, axis=1)[:, len(at) - k])
            query, point = np.nonzero(fast + slack >= least[:, None])
            if not len(query):
                continue
            exact = (self.asked[rows[query]] * self.vectors[at[point]]).sum(axis=1)
            # With what the queries that have something new hold already.
            touched = np.unique(query)
            held_query, held_place = np.nonzero(self.found[rows[touched]] >= 0)
            held_query = touched[held_query]
            query = np.concatenate([held_query, query])
            found = np.concatenate([self.found[rows[touched]][self.found[rows[touched]] >= 0], at[point]])
            score = np.concatenate([self.score[rows[held_query], held_place], exact])
            order = np.lexsort((self.ids[found], -score, query))
            query, found, score = query[order], found[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            first = place < k
            self.found[rows[query[first]], place[first]] = found[first]
            self.score[rows[query[first]], place[first]] = score[first]


def _clean(batches):
    """Finite vectors other than zero, as bytes of doubles."""
    for batch in batches:
        ids, out = batch.column("vec_id").to_pylist(), []
        for number, vector in zip(ids, batch.column("embedding").to_pylist()):
            if number is None or not vector or any(x is None for x in vector):
                continue
            values = np.array(vector, dtype=np.float64)
            if np.isfinite(values).all() and values.any():
                out.append((number, len(values), float((values**2).sum()), values.tobytes()))
        if out:
            columns = list(zip(*out))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.binary()))], names=["vec_id", "size", "square", "vector"])


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table.column("vec_id"))
    values = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def _plant(top: float, k: int, leaf: int):
    """One shard's tree. Equal vectors are one point with the ``k`` + 1 least ids."""

    def run(group: pa.Table) -> pa.Table:
        ids, values = _matrix(group)
        points, place = np.unique(values, axis=0, return_inverse=True)
        order = np.argsort(place.ravel(), kind="stable")
        cuts = np.searchsorted(place.ravel()[order], np.arange(len(points) + 1))
        own = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(cuts, cuts[1:])]
        # One more coordinate turns the largest inner product into the least distance.
        rest = np.sqrt(np.maximum(top - (points**2).sum(axis=1), 0))
        tree = VPTree(np.column_stack([points, rest]), leaf)
        blob = pickle.dumps((tree.order, tree.nodes, points, rest, top, own), protocol=5)
        return pa.table([group.column("size").slice(0, 1), group.column("shard").slice(0, 1), pa.array([blob], pa.binary())], names=["size", "shard", "tree"])

    return run


def _pack(group: pa.Table) -> pa.Table:
    ids, values = _matrix(group)
    return pa.table(
        [group.column("size").slice(0, 1), group.column("block").slice(0, 1), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())],
        names=["size", "block", "ids", "vectors"],
    )


def _search(k: int, relax: float):
    def run(batches):
        for batch in batches:
            for blob, ids, vectors in zip(*[batch.column(c) for c in ("tree", "ids", "vectors")]):
                tree = VPTree.__new__(VPTree)
                tree.order, tree.nodes, points, rest, top, own = pickle.loads(blob.as_py())
                ids = np.frombuffer(ids.as_py(), np.int64)
                queries = np.frombuffer(vectors.as_py(), np.float64).reshape(len(ids), -1)
                # One more than asked for: a query may find itself.
                least = np.array([o[0] for o in own])
                search = Products(tree, points, rest, top, least, queries, k + 1, relax)
                out = []
                for query, row, scores in zip(ids.tolist(), search.found.tolist(), search.score.tolist()):
                    pairs = [(-s, i) for s, at in zip(scores, row) if at >= 0 for i in own[at].tolist() if i != query]
                    out += [(query, i, -s) for s, i in sorted(pairs)[:k]]
                columns = list(zip(*out)) if out else [[], [], []]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, queries: Column, *, k: int = NEIGHBOURS, relax: float = RELAX, shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows of ``vectors`` (vec_id, embedding) that meet
    ``queries`` the ``k`` others of largest inner product, ties to the smaller id.

    Vectors are dealt to shards of about ``shard_rows`` by a hash of their id, each with a
    vantage-point tree; queries search the trees in blocks. A branch is left out where the triangle
    inequality, with the bound taken ``relax`` times, shows no nearer point; 1 is exact. The
    score is taken in doubles from the vectors as they are.

    Null, empty and zero vectors, those with a null or non-finite component and null ids take no
    part. Vectors of other length than the query's are no candidates. Of rows with one id one
    counts. With fewer than ``k`` candidates all are returned.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        _clean, "vec_id long, size int, square double, vector binary"
    )
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "size", "square")).alias("v")).select("vec_id", "v.*")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("top")).first()
    shards = max(1, -(-sums.n // shard_rows))
    planted = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("size", "shard").applyInArrow(
        _plant(float(sums.top or 0), k, leaf_rows), "size int, shard int, tree binary"
    )
    asked = rows.filter(queries)
    blocks = max(1, -(-asked.count() // block_queries))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("size", "block").applyInArrow(
        _pack, "size int, block int, ids binary, vectors binary"
    )
    tasks = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # Blocks meet shards in equal tasks.
    met = tasks.join(planted, ["size", "shard"]).select("tree", "ids", "vectors")
    found = met.mapInArrow(_search(k, relax), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
