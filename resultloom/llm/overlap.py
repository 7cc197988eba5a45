"""Texts that have most of their word shingles in common, by an exact prefix-filter join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.llm.text import Rolling, Words, bucket_count, bytes_of, concat, dealt, lower_ascii, mix, pieces, runs, text_bytes, windows
from resultloom.operators.components import components
from resultloom.operators.skew import lookup
from resultloom.runtime import discard, materialize

WORDS = 5
SIMILARITY = 0.8
# Counters that tell rare shingles from frequent ones, about one for every word of the corpus up to
# 16 MB of them; they set the order only, so a shared one loses no pair.
LEAST_BITS, MOST_BITS, SLICES = 16, 24, 16
BUCKET_BYTES = 32 << 20
# Cells in which the shingles of a set are counted, for sets small enough that the counts tell them apart.
CELLS, CELL_SHINGLES = 128, 4096
# Bits that mark the texts a step needs again, up to 2 MB; a text marked by chance is dropped by a join.
MARK_BITS = 24


class Shingles:
    """Distinct five-word shingles of the texts of a batch: ``hashes`` in order within each of ``rows``.

    Lower-cases A-Z and splits on ASCII white space; a text with fewer words is one shingle.
    ``key`` is equal for texts with the same set, of which ``counts`` has the size.
    """

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = bytes_of(texts)
        words = Words(lower_ascii(data), offsets)
        hashes, splits = words.hashes, words.splits
        first, long = windows(hashes, splits, WORDS)
        few = np.flatnonzero((words.counts > 0) & (words.counts < WORDS))
        rows = np.concatenate([np.searchsorted(splits, first, side="right") - 1, few])
        found = np.concatenate([long, Rolling(hashes).ranges(splits[few], splits[few + 1])])
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])])[: len(rows)]
        self.rows, self.hashes = rows[new], found[new]
        self.counts = np.bincount(self.rows, minlength=len(offsets) - 1)
        self.ends = np.cumsum(self.counts)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes, 31))])
        self.key = mix(sums[self.ends] - sums[self.ends - self.counts] + self.counts.astype(np.uint64), 32).view(np.int64)


def _cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _count(bits: int):
    """Occurrences per counter in a task, no more than 255: those that have some, or a bit for each of a slice and those over one."""

    def run(batches):
        total = np.zeros(1 << bits, np.uint8)
        for batch in pieces(batches, "text"):
            cells, counts = np.unique(_cell(Shingles(batch.column("text")).hashes, bits), return_counts=True)
            total[cells] = np.minimum(total[cells] + counts, 255)
        width = len(total) // SLICES
        for number in range(SLICES):
            own = total[number * width : (number + 1) * width]
            at = np.flatnonzero(own)
            if len(at):
                held = b""
                if len(at) * 40 > width:
                    held, at = np.packbits(own > 0).tobytes(), np.flatnonzero(own > 1)
                blobs = (held, at.astype(np.uint32).tobytes(), own[at].tobytes())
                yield pa.record_batch([pa.array([number], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["slice", "held", "at", "counts"])

    return run


def _levels(bits: int):
    def run(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // SLICES, np.int64)
        for held, at, counts in zip(*[group.column(c) for c in ("held", "at", "counts")]):
            held, at, counts = [np.frombuffer(x.as_py(), t) for x, t in ((held, np.uint8), (at, np.uint32), (counts, np.uint8))]
            if len(held):
                total += np.unpackbits(held)
            total[at] += counts - 1 if len(held) else counts
        levels = np.ceil(np.log2(total + 1)).astype(np.uint8)
        return pa.table([group.column("slice").slice(0, 1), pa.array([levels.tobytes()], pa.binary())], names=["slice", "levels"])

    return run


def _cells(batches):
    """Per text: its shingles by cell; none for a large one."""
    for batch in pieces(batches, "text"):
        own = Shingles(batch.column("text"))
        cell = (mix(own.hashes, 35) % np.uint64(CELLS)).astype(np.int64)
        counts = np.bincount(own.rows * CELLS + cell, minlength=len(own.counts) * CELLS).reshape(len(own.counts), CELLS)
        told = [c if n <= CELL_SHINGLES else [] for c, n in zip(counts.astype(np.int16), own.counts)]
        yield pa.record_batch([batch.column("text_key"), pa.array(told, pa.list_(pa.int16()))], names=["text_key", "cells"])


def _prefixes(levels, bits: int, similarity: float, buckets: int):
    """The rarest shingles of each text, so many that two similar texts must share one of them."""

    def run(batches):
        table = np.frombuffer(levels.value, np.uint8)
        for batch in pieces(batches, "text"):
            own = Shingles(batch.column("text"))
            level = table[_cell(own.hashes, bits)]
            order = np.lexsort((own.hashes, level, own.rows))
            place = np.arange(len(order)) - (own.ends - own.counts)[own.rows]
            take = own.counts - np.ceil(similarity * own.counts - 1e-9).astype(np.int64) + 1
            # Texts with one set are one, and a shingle counted once has no partner.
            once = np.zeros(len(own.key), bool)
            once[np.unique(own.key, return_index=True)[1]] = True
            lone = np.bincount(own.rows[level <= 1], minlength=len(own.counts))
            first = (place < take[own.rows]) & once[own.rows] & (level[order] > 1)
            keys, rows, place = own.hashes[order][first], own.rows[first], place[first]
            packed = []
            # Prefixes lean to small hashes; mixed again, the keys fill all buckets alike.
            for bucket, at in dealt(mix(keys, 34), buckets):
                texts, counts = runs(rows[at])
                packed.append((bucket, keys[at].tobytes(), place[at].astype(np.uint32).tobytes(), own.key[texts].tobytes(), own.counts[texts].astype(np.uint32).tobytes(), lone[texts].astype(np.uint32).tobytes(), counts.tobytes()))
            if packed:
                columns = list(zip(*packed))
                yield pa.record_batch([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=_PREFIX)

    return run


_PREFIX = ["bucket", "keys", "places", "sets", "sizes", "lone", "runs"]


def _shared(group: pa.Table) -> pa.Table:
    """Prefix shingles that more than one set has, once for each set."""
    keys, places = concat(group.column("keys"), np.uint64), concat(group.column("places"), np.uint32)
    counts = concat(group.column("runs"), np.int32)
    sets, sizes, lone = [np.repeat(concat(group.column(c), t), counts) for c, t in (("sets", np.int64), ("sizes", np.uint32), ("lone", np.uint32))]
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])])[: len(keys)]
    keys, sets, order = keys[new], sets[new], order[new]
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    many = count[number] > 1
    order = order[many]
    return pa.table(
        [pa.array(keys[many].view(np.int64)), pa.array(sets[many]), *[pa.array(x[order].astype(np.int32)) for x in (sizes, places, lone)]],
        names=["key", "set", "size", "place", "lone"],
    )


def _mark(batches):
    """Bits of the keys of a task, a slice of them at a time."""
    total = np.zeros(1 << MARK_BITS, bool)
    for batch in batches:
        total[_cell(mix(np.asarray(batch.column("text_key")).view(np.uint64), 33), MARK_BITS)] = True
    width = len(total) // SLICES
    for number in range(SLICES):
        at = np.flatnonzero(total[number * width : (number + 1) * width])
        if len(at):
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary())], names=["slice", "at"])


def _marks(group: pa.Table) -> pa.Table:
    total = np.zeros((1 << MARK_BITS) // SLICES, bool)
    total[concat(group.column("at"), np.uint32)] = True
    return pa.table([group.column("slice").slice(0, 1), pa.array([np.packbits(total).tobytes()], pa.binary())], names=["slice", "bits"])


def _marked(marks):
    """Texts whose key is marked, whole; most of the others never leave the scan."""

    def run(batches):
        bits = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            at = _cell(mix(np.asarray(batch.column("text_key")).view(np.uint64), 33), MARK_BITS)
            yield batch.filter(pa.array(bits[at >> 3] >> (7 - (at & 7)) & 1 == 1))

    return run


def _collected(rows: DataFrame, column: str, width: int) -> bytes:
    """Slices of a table of fixed size, put together."""
    table = bytearray(width * SLICES)
    for row in rows.collect():
        table[row["slice"] * width : (row["slice"] + 1) * width] = row[column]
    return bytes(table)


def _arrays(batches):
    for batch in pieces(batches, "text"):
        own = Shingles(batch.column("text"))
        blobs = [own.hashes[e - n : e].tobytes() for n, e in zip(own.counts, own.ends)]
        yield pa.record_batch([batch.column("set"), pa.array(blobs, pa.binary())], names=["set", "hashes"])


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a_hashes"), batch.column("b_hashes")):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _marks_of(keys: DataFrame):
    """Broadcast bits that mark every ``text_key`` of ``keys``, and few others while there is room."""
    marks = keys.select("text_key").mapInArrow(_mark, "slice int, at binary").groupBy("slice").applyInArrow(_marks, "slice int, bits binary")
    return keys.sparkSession.sparkContext.broadcast(_collected(marks, "bits", (1 << MARK_BITS) // SLICES // 8))


def is_marked(keys: DataFrame, key: Column) -> Column:
    """Whether ``key`` is a ``text_key`` of ``keys``: never false for one that is, and true for some that are not."""
    marks = _marks_of(keys)

    @F.pandas_udf("boolean")
    def found(key: pd.Series) -> pd.Series:
        bits, at = np.frombuffer(marks.value, np.uint8), _cell(mix(key.to_numpy().view(np.uint64), 33), MARK_BITS)
        return pd.Series(bits[at >> 3] >> (7 - (at & 7)) & 1 == 1)

    return found(key)


def _marked_texts(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_marked(_marks_of(chosen)), docs.schema)


def _of_sets(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """``found`` of texts with the set of each, one text a set.

    A row of ``chosen`` (set, text_key) names one text of one set, so equal texts are told by their key, by which
    the join has dealt them.
    """
    return found.join(chosen, "text_key").dropDuplicates(["text_key"])


def _similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: components; a_set, b_set) whose sets are similar.

    Only the texts of sets that are in a pair are read again for their shingles.
    """
    asked = pairs.select(F.col("a_set").alias("set")).unionByName(pairs.select(F.col("b_set").alias("set"))).distinct()
    wanted = materialize(sets.join(asked, "set", "left_semi").select("set", "text_key"), "wanted")
    arrays = materialize(_of_sets(_marked_texts(wanted, docs), wanted).select("set", "text").mapInArrow(_arrays, "set long, hashes binary"), "shingles")
    own = arrays.select(F.col("set").alias("a_set"), F.col("hashes").alias("a_hashes"))
    other = arrays.select(F.col("set").alias("b_set"), F.col("hashes").alias("b_hashes"))
    both = lookup(lookup(pairs, own, ["a_set"]), other, ["b_set"]).select("a", "b", "a_hashes", "b_hashes")
    found = materialize(both.mapInArrow(_verify(similarity), "a long, b long").distinct(), "similar")
    discard(arrays)
    discard(wanted)
    return found


def _merged(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` with ``component`` as it is once ``edges`` of components are followed."""
    found = components(edges).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return members.join(found, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")


def join_similar(docs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(set, component): components of ``sets`` (set, component, text_key) joined where sets are similar.

    ``set`` is the key of a shingle set in ``docs`` (text_key, text), component what is known to
    belong together. All pairs of sets with Jaccard similarity of at least ``similarity`` end in
    one component. Two such sets of m and n shingles have at least
    c = ceil(similarity / (1 + similarity) * (m + n)) in common, so with a common order of shingles they share
    one of the first m - c + 1 of the one and n - c + 1 of the other; at most n - ceil(similarity * n) + 1 of
    a set are ever looked at. The order is by frequency, so that these are rare ones, and texts of one
    template meet by what is their own. Pairs that fail by size or place are dropped before any text is read
    for them. Each set first meets one other, then one set of each two components that share a shingle, and only
    what is still apart meets whole, so a family of copies takes no pair of all its members.

    Null and blank texts have no set and are not to be in ``sets``; equal texts are one set. Empty
    frames give no rows.
    """
    spark, texts = docs.sparkSession, docs.select("text")
    size = text_bytes(docs)
    buckets, bits = bucket_count(size, BUCKET_BYTES), min(MOST_BITS, max(LEAST_BITS, (size // 6).bit_length()))
    counted = texts.mapInArrow(_count(bits), "slice int, held binary, at binary, counts binary").groupBy("slice").applyInArrow(_levels(bits), "slice int, levels binary")
    levels = spark.sparkContext.broadcast(_collected(counted, "levels", (1 << bits) // SLICES))
    dealt_out = texts.mapInArrow(_prefixes(levels, bits, similarity, buckets), ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in _PREFIX))
    shared = materialize(dealt_out.groupBy("bucket").applyInArrow(_shared, "key long, set long, size int, place int, lone int"), "prefixes")
    sets = materialize(sets, "sets")
    if shared.isEmpty():
        return sets.select("set", "component")

    def fits(a: str, b: str):
        """Whether sizes, places and, where both rows have them, counts by cell leave room for so much in common.

        What stands before the shingle in one order can only be what stands before it in the other,
        and not what occurs once in the corpus, which comes first; what follows only what follows. In
        a cell two sets have no more in common than the lesser of their counts.
        """
        m, n, p, q = F.col(f"{a}size"), F.col(f"{b}size"), F.col(f"{a}place"), F.col(f"{b}place")
        common = F.ceil((m + n) * F.lit(similarity / (1 + similarity)) - 1e-9)
        before = F.least(p - F.col(f"{a}lone"), q - F.col(f"{b}lone"))
        own, other = F.col(f"{a}cells"), F.col(f"{b}cells")
        room = F.aggregate(F.zip_with(own, other, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda total, x: total + x)
        near = (F.least(m, n) >= common) & (p <= m - common) & (q <= n - common) & (before + F.least(m - p, n - q) >= common)
        return near & F.when((F.size(own) > 0) & (F.size(other) > 0), room >= common).otherwise(True)

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("set", "component", "size", "place", "lone", "cells")])

    def followed(pairs: DataFrame, members: DataFrame, *spent: DataFrame) -> DataFrame:
        """``members`` once the similar ones of ``pairs`` are followed."""
        pairs = materialize(pairs.select("a", "b", "a_set", "b_set"), "pairs")
        found = _similar(pairs, docs, members, similarity)
        merged = materialize(_merged(members, found), "sets")
        for frame in (pairs, found, members, *spent):
            discard(frame)
        return merged

    def open_rows(members: DataFrame) -> DataFrame:
        """Rows of the shingles whose sets are in more than one component; the others are settled."""
        rows = lookup(shared, members.select("set", "component"), ["set"])
        keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
        return materialize(lookup(lookup(rows, keys, ["key"]), cells, ["set"]), "open")

    ends = [F.col("a_component").alias("a"), F.col("b_component").alias("b"), "a_set", "b_set"]
    differ = (F.col("a_component") != F.col("b_component")) & fits("a_", "b_")
    # Every set meets one other: the least of those that are first of a shingle it has.
    none = F.array().cast("array<smallint>")
    rows = lookup(shared, sets.select("set", "component"), ["set"]).withColumn("cells", none)
    least = rows.groupBy("key").agg(F.min(F.struct("set", "component", "size", "place", "lone")).alias("l")).select("key", "l.*")
    least = least.withColumn("cells", none)
    stars = lookup(side(rows, "a"), side(least, "b"), ["key"]).filter(differ).select(*ends)
    stars = stars.groupBy("a_set").agg(F.min(F.struct("b_set", "b", "a")).alias("m")).select("m.a", "m.b", "a_set", "m.b_set")
    members = followed(stars, sets)
    # Of every two components that share a shingle, one set of each meets, if their counts by cell allow it.
    chosen = materialize(members.join(shared.select("set").distinct(), "set", "left_semi").select("set", "text_key"), "chosen")
    counted = _marked_texts(chosen, docs).mapInArrow(_cells, "text_key long, cells array<smallint>")
    cells = materialize(_of_sets(counted, chosen).select("set", "cells"), "cells")
    rows = open_rows(members)
    first = rows.groupBy("key", "component").agg(F.min(F.struct("set", "size", "place", "lone", "cells")).alias("l")).select("key", "component", "l.*")
    pairs = side(first, "a").join(side(first, "b"), "key").filter(differ & (F.col("a_component") < F.col("b_component"))).select(*ends)
    pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("a_set", "b_set")).alias("m")).select("a", "b", "m.*")
    members = followed(pairs, members, rows)
    # What is still apart meets whole.
    rows = open_rows(members)
    pairs = side(rows, "a").join(side(rows, "b"), "key").filter(differ & (F.col("a_set") < F.col("b_set"))).select(*ends).distinct()
    members = followed(pairs, members, rows, shared, cells, chosen)
    return members.select("set", "component")
