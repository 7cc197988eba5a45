"""Removal of passages that an earlier document has, by hashed token windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from resultloom.llm.text import (
    Words, bucket_count, bytes_of, concat, dealt, id_key, ids_of, mix, pieces, runs, text_bytes, windows,
)

WINDOW = 13
# Text bytes whose windows one counting group holds.
BUCKET_BYTES = 8 << 20

_ENTRIES = "key int, marked boolean, hashes binary, docs binary, runs binary"


def _entries(keys: np.ndarray, count: int, marked: bool, hashes: np.ndarray, docs: np.ndarray) -> list[tuple]:
    """Windows dealt by ``keys``: their hashes in order of document, and the documents' runs."""
    rows = []
    order = np.argsort(docs, kind="stable")
    hashes, docs = hashes[order], docs[order]
    for key, part in dealt(keys[order], count):
        ids, lengths = runs(docs[part])
        rows.append((key, marked, hashes[part].tobytes(), ids.tobytes(), lengths.tobytes()))
    return rows


def _batch(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _unpack(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, lengths = concat(group.column("docs"), np.int64), concat(group.column("runs"), np.int32)
    return concat(group.column("hashes"), np.uint64), np.repeat(ids, lengths)


def _later(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes and documents, which are a window's first and which have a lesser document."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
    later = docs != docs[first][np.cumsum(first) - 1] if len(docs) else first
    return hashes, docs, first, later


def _scan(window: int, buckets: int):
    """Each window once per piece with its least document; later ones are marked at once."""

    def run(batches):
        for batch in pieces(batches, "text"):
            words = Words(*bytes_of(batch.column("text")))
            at, hashes = windows(words.hashes, words.splits, window)
            docs = ids_of(batch, "doc_id")[words.rows()[at]]
            hashes, docs, first, later = _later(hashes, docs)
            later[1:] &= (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
            rows = _entries(hashes[first], buckets, False, hashes[first], docs[first])
            rows += _entries(hashes[later], buckets, True, hashes[later], docs[later])
            yield from _batch(rows, _ENTRIES).to_batches()

    return run


def _count(groups: int):
    """Windows of one bucket that a lesser document has too, dealt to groups of documents."""

    def run(table: pa.Table) -> pa.Table:
        marked = table.column("marked")
        hashes, docs, _, later = _later(*_unpack(table.filter(pc.invert(marked))))
        more, whose = _unpack(table.filter(marked))
        hashes, docs = np.concatenate([hashes[later], more]), np.concatenate([docs[later], whose])
        return _batch(_entries(mix(docs.view(np.uint64)), groups, True, hashes, docs), _ENTRIES)

    return run


def _by_document(group: pa.Table) -> pa.Table:
    hashes, docs = _unpack(group)
    order = np.argsort(docs, kind="stable")
    ids, lengths = runs(docs[order])
    parts = np.split(hashes[order], np.cumsum(lengths)[:-1]) if len(ids) else []
    return _batch([(int(i), p.tobytes()) for i, p in zip(ids, parts)], "doc_key long, hashes binary")


def repeated_windows(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(doc_key, hashes): window hashes of each document that a lesser document also has.

    A window that many documents share leaves each task once per piece of text, so
    a group of copies cannot fill one bucket.
    """
    buckets = buckets or bucket_count(text_bytes(docs), BUCKET_BYTES)
    seen = docs.select("doc_id", "text").mapInArrow(_scan(window, buckets), _ENTRIES)
    found = seen.groupBy("key").applyInArrow(_count(buckets), _ENTRIES)
    return found.groupBy("key").applyInArrow(_by_document, "doc_key long, hashes binary")


def _apply(window: int, with_text: bool):
    def run(batches):
        for batch in pieces(batches, "text"):
            data, offsets = bytes_of(batch.column("text"))
            words = Words(data, offsets)
            at, hashes = windows(words.hashes, words.splits, window)
            owner = words.rows()[at]
            cover = np.zeros(len(words.starts) + 1, dtype=np.int64)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for row, marks in enumerate(batch.column("hashes").to_pylist()):
                if marks:
                    low, high = bounds[row], bounds[row + 1]
                    bad = at[low:high][np.isin(hashes[low:high], np.frombuffer(marks, np.uint64))]
                    np.add.at(cover, bad, 1)
                    np.add.at(cover, bad + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            raw = data.tobytes()
            out, spans = [], []
            for row in range(batch.num_rows):
                low, high = words.splits[row], words.splits[row + 1]
                own = gone[low:high]
                kept = [raw[s:e] for s, e, g in zip(words.starts[low:high], words.ends[low:high], own) if not g]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                spans.append([{"start": int(s), "stop": int(e)} for s, e in edge.reshape(-1, 2)])
                out.append((int(high - low), int(own.sum()), b" ".join(kept).decode()))
            columns = [pa.array(c) for c in zip(*out)]
            columns[2] = columns[2] if with_text else pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), columns[0], columns[1],
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), columns[2].cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, *, digest: bool = False, buckets: int | None = None) -> DataFrame:
    """Each document without the passages of ``window`` words or more that a lesser one has.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Every window of
    ``window`` words gets a 64-bit Rabin-Karp hash, windows are counted over all
    documents, and those of a document that also start in one with a smaller id
    are joined to maximal ``spans`` (word positions, the stop outside) and removed. All windows are
    judged on the input. Returns doc_id, n_words, n_removed, spans and ``kept``: the words
    left, joined by one space, or with ``digest`` the SHA-256 of that.

    A null or blank text has no words; a text shorter than a window keeps all. Rows
    with the same id never mark each other; a null id counts as the largest. Two
    different windows are taken for one with a chance of 2**-64 per pair.
    """
    marks = repeated_windows(docs, window, buckets)
    joined = docs.select("doc_id", "text", id_key("doc_id").alias("doc_key")).join(marks, "doc_key", "left")
    return joined.select("doc_id", "text", "hashes").mapInArrow(
        _apply(window, not digest),
        "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string",
    )
