"""Hard negatives of anchors: Strassen products of integer tiles, kept in mergeable heaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultloom.llm.vectors import finite, matrix, packed
from resultloom.operators.skew import lookup
from resultloom.runtime import materialize

POSITIVES, NEGATIVES = 5, 10
# Components are integers of this many steps to one.
SCALE = 256
# A negative scores between 30 % and 90 % of its positive.
LOW, HIGH = 30, 90
# Candidates of one tile, anchors sent to it together, anchors of one tile.
CHUNK_ROWS, BLOCK_ROWS, TILE_ROWS = 4096, 8192, 256
# Chunks that one task meets before it gives its heaps.
STRIPE_CHUNKS = 4
# A product with a side of up to this is multiplied directly.
LEAF = 32
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def strassen(a: np.ndarray, c: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product of ``a`` and the transpose of ``c``.

    Seven products of halves replace eight; odd sides get a row or column of zeros. All additions
    are of integers, so the result is that of the plain product.
    """
    (m, k), n = a.shape, c.shape[0]
    if min(m, k, n) <= leaf:
        return np.einsum("ik,jk->ij", a, c)
    a = np.pad(a, ((0, m % 2), (0, k % 2))) if m % 2 or k % 2 else a
    c = np.pad(c, ((0, n % 2), (0, k % 2))) if n % 2 or k % 2 else c
    h, w, v = a.shape[0] // 2, a.shape[1] // 2, c.shape[0] // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b21, b12, b22 = c[:v, :w], c[:v, w:], c[v:, :w], c[v:, w:]
    out = np.empty((2 * h, 2 * v), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:h, :v] = p
    out[h:, v:] = p
    p = strassen(a21 + a22, b11, leaf)
    out[h:, :v] = p
    out[h:, v:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:h, v:] = p
    out[h:, v:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:h, :v] += p
    out[h:, :v] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:h, :v] -= p
    out[:h, v:] += p
    out[h:, v:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:h, :v] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


class Heaps:
    """For each place of an array the ``k`` best (score, id): high scores first, then small ids.

    Two such heaps of what different chunks hold merge into that of both. Empty entries come last.
    """

    def __init__(self, shape: tuple[int, ...], k: int) -> None:
        self.scores = np.full((*shape, k), NONE)
        self.ids = np.full((*shape, k), LAST)

    def merge(self, at, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge (score, id) entries, of any number in the last axis, into the places ``at``."""
        both, names = np.concatenate([self.scores[at], scores], axis=-1), np.concatenate([self.ids[at], ids], axis=-1)
        # The least integer has no negative; ~x turns the order round without overflow.
        order = np.lexsort((names, ~both), axis=-1)[..., : self.scores.shape[-1]]
        self.scores[at] = np.take_along_axis(both, order, axis=-1)
        self.ids[at] = np.take_along_axis(names, order, axis=-1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` first of each row; ``ids`` are in order, so a stable sort breaks ties by id."""
    order = np.argsort(~scores, axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(scores, order, axis=1)
    return found, np.where(found == NONE, LAST, ids[order])


def _windows(scores: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each of its windows [low, high] the ``k`` first entries in it."""
    order = np.argsort(~scores, axis=1, kind="stable")
    ranked = np.take_along_axis(scores, order, axis=1)
    n = scores.shape[1]
    start = np.empty(low.shape, np.int64)
    for row in range(len(ranked)):
        # Ranked scores fall, their complements rise.
        start[row] = np.searchsorted(~ranked[row], ~high[row], side="left")
    at = start[:, :, None] + np.arange(k)
    inside = at < n
    at = np.minimum(at, n - 1).reshape(len(scores), -1)
    found = np.take_along_axis(ranked, at, axis=1).reshape(*low.shape, k)
    names = ids[np.take_along_axis(order, at, axis=1)].reshape(*low.shape, k)
    inside &= (found >= low[:, :, None]) & (found != NONE)
    return np.where(inside, found, NONE), np.where(inside, names, LAST)


def _clean(scale: int):
    """Rows that take part, components as integers."""

    def run(batches):
        for batch in batches:
            named = np.asarray(batch.column("vec_id").is_valid()) & np.asarray(batch.column("label").is_valid())
            batch = batch.filter(pa.array(named))
            keep, sizes, entries = finite(batch.column("embedding"))
            whole = np.floor(scale * entries)
            if len(whole):
                largest = np.abs(whole)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                if np.any(np.add.reduceat(largest**2, starts) * HIGH >= 2.0**62):
                    raise OverflowError("scores of these vectors do not fit a long")
            own = batch.filter(pa.array(keep))
            yield pa.record_batch(
                [own.column("vec_id"), own.column("label"), pa.array(sizes.astype(np.int32)), packed(whole.astype(np.int64), sizes)],
                names=["vec_id", "label", "size", "vector"],
            )

    return run


def _chunk(group: pa.Table) -> pa.Table:
    """A chunk of candidates in one row, in order of id."""
    group = group.sort_by("vec_id")
    cells = [np.asarray(group.column(c)).tobytes() for c in ("vec_id", "label")]
    cells.append(matrix(group.column("vector")).tobytes())
    keys = [group.column(c).slice(0, 1) for c in ("size", "bucket", "chunk")]
    return pa.table([*keys, *[pa.array([c], pa.binary()) for c in cells]], names=["size", "bucket", "chunk", "ids", "labels", "vectors"])


def _block(positives: int):
    """A block of anchors in one row; ``bars`` are the scores of their positives, as many as there are."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        bars, partners = np.full((len(group), positives), NONE), np.full((len(group), positives), LAST)
        for row, own in enumerate(group.column("positives").to_pylist()):
            for place, item in enumerate(own or []):
                bars[row, place], partners[row, place] = item["score"], item["vec_id"]
        cells = [np.asarray(group.column(c)).tobytes() for c in ("vec_id", "label")]
        cells += [matrix(group.column("vector")).tobytes(), bars.tobytes(), partners.tobytes()]
        keys = [group.column(c).slice(0, 1) for c in ("size", "bucket", "block")]
        names = ["size", "bucket", "block", "a_ids", "a_labels", "a_vectors", "bars", "partners"]
        return pa.table([*keys, *[pa.array([c], pa.binary()) for c in cells]], names=names)

    return run


def _met(positives: int, negatives: int, low: int, high: int, tile_rows: int, windows: bool):
    """Meet each block with the chunks that follow it; its heaps are given when the block ends."""

    def flush(ids, partners, bars, heaps):
        full = heaps.ids != LAST
        if windows:
            row, place, rank = np.nonzero(full)
            columns = [ids[row], partners[row, place], bars[row, place], heaps.ids[full], heaps.scores[full]]
            names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]
        else:
            row, rank = np.nonzero(full)
            columns, names = [ids[row], heaps.ids[full], heaps.scores[full]], ["anchor_id", "vec_id", "score"]
        return pa.record_batch([pa.array(c) for c in columns], names=names)

    def run(batches):
        held = None
        for batch in batches:
            for at in range(batch.num_rows):
                cell = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                key = (cell["size"], cell["bucket"], cell["block"])
                if held is None or held[0] != key:
                    if held:
                        yield flush(*held[1])
                    ids = np.frombuffer(cell["a_ids"], np.int64)
                    bars = np.frombuffer(cell["bars"], np.int64).reshape(len(ids), positives)
                    partners = np.frombuffer(cell["partners"], np.int64).reshape(len(ids), positives)
                    heaps = Heaps((len(ids), positives), negatives) if windows else Heaps((len(ids),), positives)
                    held = key, (ids, partners, bars, heaps)
                    labels, anchors = np.frombuffer(cell["a_labels"], np.int64), np.frombuffer(cell["a_vectors"], np.int64).reshape(len(ids), -1)
                    # Bars that are missing have an empty window.
                    missing = bars == NONE
                    value = np.where(missing, 0, bars)
                    least = np.where(missing, LAST, -((-low * value) // 100))
                    most = np.where(missing, NONE, (high * value) // 100)
                others = np.frombuffer(cell["ids"], np.int64)
                kinds, vectors = np.frombuffer(cell["labels"], np.int64), np.frombuffer(cell["vectors"], np.int64).reshape(len(others), -1)
                for start in range(0, len(ids), tile_rows):
                    rows = slice(start, start + tile_rows)
                    scores = strassen(anchors[rows], vectors)
                    same = labels[rows, None] == kinds
                    if windows:
                        scores = np.where(same, NONE, scores)
                        heaps.merge(rows, *_windows(scores, others, least[rows], most[rows], negatives))
                    else:
                        scores = np.where(same & (ids[rows, None] != others), scores, NONE)
                        heaps.merge(rows, *_best(scores, others, positives))
        if held:
            yield flush(*held[1])

    return run


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
    low: int = LOW, high: int = HIGH, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and embedding; anchors are the rows that meet ``anchors``. Components become
    floor(``scale`` * x), a score is the integer inner product. An anchor's positives are its first
    ``positives`` other rows of its label by falling score, ties by smaller id. For each the first
    ``negatives`` rows of another label are given, in the same order, whose score is ``low`` to
    ``high`` percent of the positive's.

    Candidates are dealt to chunks and anchors to blocks. A block meets the chunks of its labels for
    the positives, and every chunk for the negatives; a task runs through the chunks of one stripe
    with one set of heaps, and Spark merges those of the stripes. No chunk grows with a label.

    Rows with a null id, label or vector, an empty vector or a null or non-finite component take no
    part; vectors of other length than the anchor's are no candidates. Of rows with one id the
    least by (vector, label) counts. An anchor without positives, and a positive without negatives,
    give no row. Vectors so large that a score could leave the range of a long raise OverflowError.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.mapInArrow(_clean(scale), "vec_id long, label long, size int, vector binary")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "size", "label")).alias("v")).select("vec_id", "v.*")
    rows = materialize(rows, "vectors")
    # Labels share buckets where there are many; a bucket is cut into chunks.
    buckets = max(1, -(-rows.count() // chunk_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int"))
    chunk_type = "size int, bucket int, chunk int, ids binary, labels binary, vectors binary"
    block_type = "size int, bucket int, block int, a_ids binary, a_labels binary, a_vectors binary, bars binary, partners binary"

    def stripes(asked: DataFrame, chunks: DataFrame, keys: list[str], counts: DataFrame, windows: bool, out: str) -> DataFrame:
        """Heaps of each block over each stripe: blocks go to all stripes, chunks to all blocks of their key."""
        blocks = asked.groupBy("size", "bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        dealt = lookup(asked, blocks, ["size", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
        packs = dealt.drop("blocks").groupBy("size", "bucket", "block").applyInArrow(_block(positives), block_type)
        last = F.floor((F.col("chunks") - 1) / STRIPE_CHUNKS).cast("int")
        left = packs.join(counts, keys).withColumn("stripe", F.explode(F.sequence(F.lit(0), last))).drop("chunks")
        right = chunks.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = right.withColumn("stripe", F.floor(F.col("chunk") / STRIPE_CHUNKS).cast("int"))
        met = left.join(right, ["size", "bucket", "block", "stripe"])
        return met.mapInArrow(_met(positives, negatives, low, high, tile_rows, windows), out)

    def ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    def dealt_out(candidates: DataFrame, counts: DataFrame) -> DataFrame:
        own = lookup(candidates, counts, ["size", "bucket"])
        own = own.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("chunks")).cast("int")).drop("chunks")
        return own.groupBy("size", "bucket", "chunk").applyInArrow(_chunk, chunk_type)

    def chunk_counts(candidates: DataFrame) -> DataFrame:
        return candidates.groupBy("size", "bucket").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))

    # Positives: only chunks that can hold the anchor's label.
    keys = ["size", "bucket"]
    none = F.lit(None).cast("array<struct<score: bigint, vec_id: bigint>>")
    counts = materialize(chunk_counts(rows), "chunks")
    asked = rows.filter(anchors)
    found = stripes(asked.withColumn("positives", none), dealt_out(rows, counts), keys, counts, False, "anchor_id long, vec_id long, score long")
    first = ranked(found, ["anchor_id"], positives).groupBy("anchor_id").agg(F.collect_list(F.struct("score", "vec_id")).alias("positives"))
    # Negatives: all chunks of that length, whatever their label.
    asked = materialize(asked.join(first, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "anchors").withColumn("bucket", F.lit(0))
    everyone = rows.withColumn("bucket", F.lit(0))
    counts = materialize(chunk_counts(everyone), "chunks")
    out = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    met = stripes(asked, dealt_out(everyone, counts), keys, counts, True, out)
    return ranked(met, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
