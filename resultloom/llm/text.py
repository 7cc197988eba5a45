"""Vectorised pieces shared by the text operators: batches, words and fingerprints.

Every function here works on one Arrow batch inside a Spark task. Texts are taken
whole; a batch is cut between rows only, so that a task holds a few MB at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text bytes handled at once; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20
# The id that stands for a null one: after all others.
LAST_ID = 2**63 - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread each 64-bit value over all bits (the splitmix64 finaliser)."""
    x = x + np.uint64((seed * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64."""
    out = np.full(count, np.uint64(base))
    if count:
        out[0] = 1
    return np.cumprod(out)


class Rolling:
    """Rabin-Karp hashes of any ranges of one sequence, from one prefix sum."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(_BASE, n), out=self.sums[1:])
        self.undo = powers(_UNBASE, n + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.undo[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """Words (runs of other than ASCII white space) of the texts of a batch.

    ``starts`` and ``ends`` are byte positions, ``splits[i]:splits[i + 1]`` are the
    words of text i, and ``hashes`` has a 64-bit fingerprint of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        solid = ~_SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = solid[begins]
        stops = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[stops] = solid[stops]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.splits = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.splits)

    @property
    def hashes(self) -> np.ndarray:
        return Rolling(_BYTE[self.data]).ranges(self.starts, self.ends)

    def rows(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, splits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words inside one text."""
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - size + 1)
    end_of_text = np.repeat(splits[1:], np.diff(splits))
    at = at[at + size <= end_of_text[: len(at)]]
    return at, Rolling(hashes).ranges(at, at + size)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that a piece holds about ``limit`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
        total, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def ids_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Integer ids, null as the last of all."""
    return np.asarray(pc.fill_null(batch.column(column).cast(pa.int64()), LAST_ID))


def dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the hashes, dealt by their leading bits."""
    if not len(hashes):
        return
    bucket = bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        yield int(bucket[part[0]]), part


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def concat(blobs: pa.ChunkedArray, dtype) -> np.ndarray:
    """The numbers of all binary cells, one after another."""
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=dtype)


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and run lengths of ids that stand in order."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
    return ids[first], np.diff(np.append(first, len(ids))).astype(np.int32)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in the table: one number, from which bucket counts are taken."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def bucket_count(total_bytes: int, per_bucket: int) -> int:
    """Buckets, so that one holds about ``per_bucket`` bytes however large the input."""
    return max(8, -(-total_bytes // per_bucket))


def id_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))
