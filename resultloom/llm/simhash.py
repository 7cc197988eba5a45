"""SimHash fingerprints, and their links by BK-trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.llm.overlap import SIMILARITY, Shingles, is_marked, join_similar
from resultloom.llm.text import LAST_ID, id_key, pieces
from resultloom.operators.components import components
from resultloom.runtime import materialize

RADIUS = 3
SHINGLE = 3
# Fingerprints in one tree at most; fuller groups are cut finer, then into shards.
TREE_NODES = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles: a bit is set if over half of their XXH64 have it.

    Lower-cases A-Z and splits on ASCII white space. Repeated shingles count again; a text
    with fewer words than a shingle is one shingle, a text without words gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in spans], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low : low + (1 << 16)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


class BKTree:
    """A BK-tree of 64-bit fingerprints: children keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within ``radius``: only edges that can lead there are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        new, node = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while new:
            edge = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(edge, new)
            if node == new:
                return


def _links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A star for each group of values that the tree links: (least, other)."""
    tree, root = BKTree(), []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        root.append(i)
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.add(value)
    return [(values[top(i)], v) for i, v in enumerate(values) if top(i) != i]


def _search(radius: int):
    """Trees over rows sorted by group: each group is one shard's tree, queried by its members."""

    def run(batches):
        held_key, held = None, []
        found: list[tuple[int, int]] = []
        for batch in batches:
            keys, values = batch.column("shard").to_pylist(), batch.column("fp").to_pylist()
            for key, value in zip(keys, values):
                if key != held_key:
                    if len(held) > 1:
                        found += _links(held, radius)
                    held_key, held = key, []
                held.append(value & (2**64 - 1))
            if found:
                yield _edges(found)
                found = []
        if len(held) > 1:
            found = _links(held, radius)
        yield _edges(found)

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _bits(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def linked(fingerprints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b): links that connect the same distinct ``fp`` as all pairs within ``radius`` do.

    Two values with at most 3 different bits agree on one of four blocks of 16 bits, so
    each value goes to four groups and no pair in another group is looked at. A group
    fuller than one tree is cut again by four blocks of the other 48 bits; one still
    fuller is cut into shards, of which each two meet. Trees reach their queries by the
    shuffle. A tree gives one star for what it links, not its pairs.
    """
    if radius > 3:
        raise ValueError("four blocks find up to three different bits")
    fp = F.col("fp")
    first = fingerprints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), (_bits(fp, 16 * i, 16) + F.lit(i << 16)).alias("key")) for i in range(4)
    ])).alias("g")).select("fp", "g.i", "g.key")
    sizes = materialize(first.groupBy("key").count().filter("count > 1"), "blocks")
    fits = first.join(sizes.filter(F.col("count") <= tree_nodes).select("key"), "key").select("key", "fp")
    fuller = first.join(sizes.filter(F.col("count") > tree_nodes).select("key"), "key")
    rest = F.lit(0).cast("long")
    for i in range(4):
        low = _bits(fp, 0, 16 * i) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = F.when(F.col("i") == i, high.bitwiseOR(low)).otherwise(rest)
    second = fuller.withColumn("rest", rest).select("fp", F.explode(F.array(*[
        (F.shiftleft(F.col("key"), 16) + _bits(F.col("rest"), 12 * j, 12) + F.lit((j + 1) << 12)) for j in range(4)
    ])).alias("key"))
    if sizes.filter(F.col("count") > tree_nodes).isEmpty():
        groups = fits.select(F.concat_ws(".", F.col("key")).alias("shard"), "fp")
    else:
        counts = second.groupBy("key").count().filter("count > 1")
        cut = counts.withColumn("shards", F.ceil(F.col("count") / tree_nodes).cast("long"))
        own = F.pmod(F.xxhash64("fp"), F.col("shards"))
        # Shard s meets every other one once: as (s, t) for t >= s and (t, s) for t < s.
        pairs = second.join(cut, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        pairs = pairs.filter((F.col("shards") == 1) | (F.col("own") != F.col("other")))
        groups = fits.select(F.concat_ws(".", F.col("key")).alias("shard"), "fp").unionByName(
            pairs.select(F.concat_ws(".", "key", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp")
        )
    sorted_groups = groups.repartition("shard").sortWithinPartitions("shard", "fp")
    return sorted_groups.mapInArrow(_search(radius), "a long, b long").distinct()


def _fingerprints(batches):
    for batch in pieces(batches, "text"):
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(found)], names=["doc_id", "text_key", "fp"])


def _components(docs: DataFrame, radius: int, tree_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(prints, names): fingerprints of the rows, and the component of each distinct one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    prints = materialize(rows.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long"), "fingerprints")
    # The first row of a component: smallest id, null last, then by text.
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    least = materialize(prints.groupBy("fp").agg(F.min(place).alias("least")), "distinct")
    found = components(linked(least.select("fp"), radius, tree_nodes))
    named = least.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    return prints, named


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    Fingerprints that differ in at most ``radius`` bits are linked; component_id is the
    smallest doc_id reachable. Null and blank texts have fingerprint zero and are linked
    like others. Rows with the same id stay separate rows; a null id is in its component
    but never names it, unless all are null. Other columns are ignored.
    """
    prints, named = _components(docs, radius, tree_nodes)
    names = named.groupBy("component").agg(F.min("least").alias("first"))
    per_print = named.select("fp", "component").join(names, "component").select("fp", F.col("first.doc_id").alias("component_id"))
    # Many rows may share a print; they are the left side, which Spark splits when it is skewed.
    return prints.join(per_print, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _sets(batches):
    for batch in pieces(batches, "text"):
        own = Shingles(batch.column("text"))
        yield pa.record_batch([batch.column("text_key"), pa.array(own.key, mask=own.counts == 0)], names=["text_key", "set"])


def _with_similar(docs: DataFrame, prints: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """``named`` with components joined where texts of them have similar shingle sets."""
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text")
    sets = texts.mapInArrow(_sets, "text_key long, set long").filter("set is not null").distinct()
    own = prints.select("text_key", "fp").distinct().join(named.select("fp", "component"), "fp").select("text_key", "component")
    own = materialize(sets.join(own, "text_key"), "sets")
    # Texts with equal sets are one; what they link is followed first.
    equal = own.groupBy("set").agg(F.min("component").alias("a"), F.min("text_key").alias("text_key"))
    links = own.select("set", F.col("component").alias("b")).join(equal, "set").select("a", "b").filter("a <> b")
    merged = components(links).select(F.col("node").alias("before"), F.col("component").alias("after"))
    start = equal.join(merged, F.col("a") == F.col("before"), "left").select("set", F.coalesce("after", "a").alias("component"), "text_key")
    done = join_similar(texts, start, similarity)
    # Every old component hangs from all its sets, so from where these went.
    moves = own.join(done.withColumnRenamed("component", "to"), "set").select(F.col("component").alias("a"), F.col("to").alias("b"))
    found = components(moves.distinct()).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return named.join(found, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")


def one_of_each(
    docs: DataFrame, *, radius: int = RADIUS, tree_nodes: int = TREE_NODES, similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest id.

    Besides fingerprints within ``radius``, texts are linked whose sets of five-word shingles have
    a Jaccard similarity of at least ``similarity``. Of rows with one id the text's hash decides,
    of equal rows one stays.
    """
    prints, named = _components(docs, radius, tree_nodes)
    named = _with_similar(docs, prints, materialize(named, "named"), similarity)
    first = named.groupBy("component").agg(F.min("least").alias("first")).select(
        F.coalesce("first.doc_id", F.lit(LAST_ID)).alias("_doc"), F.col("first.text_key").alias("_text")
    )
    # Texts are dealt by their keys only where a row may go or have a twin; the others are let through where they are read.
    key = F.xxhash64("_doc", "_text").alias("text_key")
    places = prints.groupBy(id_key("doc_id").alias("_doc"), F.col("text_key").alias("_text")).count()
    first = materialize(first.join(places, ["_doc", "_text"]), "first")
    doubtful = places.join(first.filter("count = 1"), ["_doc", "_text"], "left_anti").select(key)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_key("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    rows = rows.withColumn("_doubt", is_marked(doubtful, key))
    kept = rows.filter("_doubt").join(first, ["_doc", "_text"], "left_semi").groupBy("_doc", "_text").agg(F.first("row").alias("row"))
    kept = rows.filter("not _doubt").select("row").unionByName(kept.select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
