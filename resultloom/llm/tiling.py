"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.llm.text import Rolling, Words, bytes_of, pieces, text_bytes, windows

# Words of a seed, least words of a tile, and the share of an item that tiles must cover.
SEED_WORDS = 5
TILE_WORDS = 3
COVERAGE = 0.7
# Benchmark text that one pass over the documents looks for.
BLOCK_BYTES = 16 << 20

# ASCII signs stand between words.
_SIGNS = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)


def normal_words(texts: pa.Array) -> Words:
    """Lower-case words; ASCII signs count as white space."""
    lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string())
    data, offsets = bytes_of(lowered)
    return Words(_SIGNS[data], offsets)


def _common(item: np.ndarray, text: np.ndarray, item_free, text_free, size: int) -> list[tuple[int, int]]:
    """Unmarked equal runs of ``size`` words, paired in order for each run (running Karp-Rabin)."""
    starts = []
    for words, free in ((item, item_free), (text, text_free)):
        at = np.arange(len(words) - size + 1)
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = at[taken[at + size] == taken[at]]
        starts.append((at, Rolling(words).ranges(at, at + size)))
    (i_at, i_hash), (t_at, t_hash) = starts
    shared = np.isin(t_hash, i_hash)
    if not shared.any():
        return []
    places: dict[int, list[int]] = {}
    for at, key in zip(i_at.tolist(), i_hash.tolist()):
        places.setdefault(key, []).append(at)
    found, turn = [], dict.fromkeys(places, 0)
    for at, key in zip(t_at[shared].tolist(), t_hash[shared].tolist()):
        if turn[key] < len(places[key]):
            start = places[key][turn[key]]
            if (item[start : start + size] == text[at : at + size]).all():
                found.append((start, at))
            turn[key] += 1
    return found


def tiles(item: np.ndarray, text: np.ndarray, least: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling (Wise, 1993): (item start, text start, words), longest tiles first.

    Again and again the longest run of unmarked words that both have is marked in both, so
    tiles never overlap and may stand in any order.
    """
    item_free, text_free = np.ones(len(item), bool), np.ones(len(text), bool)
    laid, high = [], min(len(item), len(text))
    while high >= least:
        low, top, size, found = least, high, 0, []
        while low <= top:
            middle = (low + top) // 2
            pairs = _common(item, text, item_free, text_free, middle)
            if pairs:
                size, found, low = middle, pairs, middle + 1
            else:
                top = middle - 1
        if not found:
            break
        for start, at in found:
            if item_free[start : start + size].all() and text_free[at : at + size].all():
                item_free[start : start + size] = text_free[at : at + size] = False
                laid.append((start, at, size))
        high = size
    return laid


def coverage(item: np.ndarray, text: np.ndarray, least: int, enough: float) -> float:
    """Share of the item's words under tiles; 0 where too few of its words occur at all."""
    least = min(least, len(item))
    near = np.isin(text, item)
    # No more of the item can be covered than occurs in the text.
    if np.isin(item, text[near]).mean() < enough:
        return 0.0
    # Only runs of the item's words can hold a tile; one other word between two runs keeps them apart.
    keep = near | np.concatenate([near[1:], [False]])
    return sum(size for _, _, size in tiles(item, text[keep], least)) / len(item)


def _block(items: list, seed: int):
    """Item numbers by seed hash, and all items' words, for one broadcast."""
    words = normal_words(pa.array([x.text for x in items], pa.string()))
    hashes = words.hashes
    seeds, owners = [], []
    for number in range(len(items)):
        own = hashes[words.splits[number] : words.splits[number + 1]]
        size = min(seed, len(own))
        if size:
            _, found = windows(own, np.array([0, len(own)]), size)
            seeds.append(found)
            owners.append(np.full(len(found), number))
    sizes = sorted({min(seed, int(c)) for c in words.counts if c})
    seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(seeds, kind="stable")
    return seeds[order], owners[order], hashes, words.splits, sizes, [x.item_id for x in items]


def _search(handle, tile: int, enough: float):
    def run(batches):
        seeds, owners, item_words, item_splits, sizes, ids = handle.value
        for batch in pieces(batches, "text"):
            words = normal_words(batch.column("text"))
            hashes, rows = words.hashes, words.rows()
            pairs = set()
            for size in sizes if len(seeds) else ():
                at, found = windows(hashes, words.splits, size)
                low = np.searchsorted(seeds, found, "left")
                hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == found)
                high = np.searchsorted(seeds, found[hit], "right")
                for row, a, b in zip(rows[at[hit]].tolist(), low[hit].tolist(), high.tolist()):
                    pairs.update((row, number) for number in owners[a:b].tolist())
            out = []
            for row, number in sorted(pairs):
                item = item_words[item_splits[number] : item_splits[number + 1]]
                share = coverage(item, hashes[words.splits[row] : words.splits[row + 1]], tile, enough)
                if share >= enough:
                    out.append((row, ids[number], share))
            if out:
                at, found, share = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), batch.column("text_key").take(pa.array(at)),
                     pa.array(found, pa.int64()), pa.array(share, pa.float64())],
                    names=["doc_id", "text_key", "item_id", "coverage"],
                )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, seed: int = SEED_WORDS, tile: int = TILE_WORDS,
    enough: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, text_key, item_id, coverage) of documents that hold a benchmark item.

    Documents and items (item_id, text) that share ``seed`` words in a row (all words of a
    shorter item) are compared by greedy string tiling with tiles of ``tile`` words or more;
    a document holds an item if the tiles cover the share ``enough`` of its words, in any order.
    Words are lower-cased and taken without ASCII signs. ``text_key`` is the XXH64 of the text,
    which tells rows with one id apart.

    Items are searched for in blocks of about ``block_bytes`` of text, one pass over the documents
    each, so what is broadcast has a bound. Null and empty texts hold nothing and items without a
    word are in nothing; repeated rows give repeated hits.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = -(-text_bytes(items) // block_bytes)
    context, keyed, found = docs.sparkSession.sparkContext, _keyed(docs), []
    for number in range(max(1, count)):
        block = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(max(1, count))) == number)
        rows = sorted(block.collect(), key=lambda x: (x.item_id is None, x.item_id, x.text))
        found.append(keyed.mapInArrow(
            _search(context.broadcast(_block(rows, seed)), tile, enough), "doc_id long, text_key long, item_id long, coverage double"
        ))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, coverage, items) of each row of ``docs``.

    ``items`` are the item ids the row's text holds, in order; coverage is the largest of them, 0
    without one. Rows with the same id and text have the same result, each in a row of its own.
    """
    hits = leaks(docs, benchmark, **options).groupBy(F.col("doc_id").alias("_id"), "text_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"),
    )
    rows = _keyed(docs).select("doc_id", F.col("text_key").alias("_key"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("text_key")), "left")
    return joined.select(
        "doc_id", F.col("coverage").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with all columns, without the rows that hold a benchmark item."""
    hits = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), "text_key").distinct()
    id_column, text = docs["doc_id"].cast("long"), docs["text"]
    return docs.join(hits, id_column.eqNullSafe(hits["_id"]) & (F.xxhash64(text) == hits["text_key"]), "left_anti")
