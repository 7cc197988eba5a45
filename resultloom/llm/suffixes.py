"""Removal of byte strings that an earlier document has, by a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.llm.text import (
    _BYTE, LAST_ID, Rolling, bucket_count, bytes_of, concat, dealt, id_key, mix, pieces, runs, text_bytes,
)

LENGTH = 50
# Bytes of the grams whose least hash names the bucket of a string.
GRAM = 16
BUCKET_BYTES = 8 << 20
# Suffixes of a new batch of the family.
BATCH = 1 << 16

_ROW = ("doc_key", "text_key")


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum) of every ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        values, have = pick(values[:-have], values[have:]), have * 2
    return pick(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


class _Stretches:
    """Maximal runs of strings of ``length`` bytes of one text whose least gram hash is the same.

    Equal strings have equal least hashes, so they meet in that hash's bucket. ``starts`` is
    the first string's byte in the batch, ``counts`` the strings of the run.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> None:
        self.keys, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.owner = self.starts
        if len(data) < length:
            return
        at = np.arange(len(data) - gram + 1)
        least = _sliding(Rolling(_BYTE[data]).ranges(at, at + gram), length - gram + 1, np.minimum)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
        inside = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][owner])
        if not len(inside):
            return
        least, owner = least[inside], owner[inside]
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
        self.keys, self.starts, self.owner = mix(least[first], 51), inside[first], owner[first]
        self.counts = np.diff(np.append(first, len(inside)))


def _table(names: list[str], kinds: list, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_KEYS = "bucket int, keys binary, docs binary, texts binary, runs binary"
_SPANS = "bucket int, starts binary, counts binary, docs binary, texts binary, runs binary"
_PARTS = "bucket int, marked boolean, bytes binary, starts binary, counts binary, docs binary, texts binary, runs binary"


def _names(schema: str) -> tuple[list[str], list]:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}
    pairs = [x.split() for x in schema.split(", ")]
    return [n for n, _ in pairs], [kinds[k] for _, k in pairs]


def _rows_of(docs: np.ndarray, texts: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rows that stand in order, as runs of (document, text)."""
    own, lengths = runs(rows)
    return docs[own].tobytes(), texts[own].tobytes(), lengths.tobytes()


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document and text of each run, run of each item)."""
    docs, texts = concat(group.column("docs"), np.int64), concat(group.column("texts"), np.int64)
    lengths = concat(group.column("runs"), np.int32)
    return docs, texts, np.repeat(np.arange(len(docs)), lengths)


def _group_of(docs: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return mix(docs.view(np.uint64) ^ mix(texts.view(np.uint64)), 52)


def _scan(length: int, gram: int, buckets: int):
    """Bucket keys of each document, each once."""

    def run(batches):
        for batch in pieces(batches, "text"):
            found = _Stretches(*bytes_of(batch.column("text")), length, gram)
            docs, texts = np.asarray(batch.column("doc_key")), np.asarray(batch.column("text_key"))
            order = np.lexsort((found.keys, found.owner))
            keys, owner = found.keys[order], found.owner[order]
            once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])[: len(keys)]
            keys, owner = keys[once], owner[once]
            rows = [(b, keys[p].tobytes(), *_rows_of(docs, texts, owner[p])) for b, p in dealt(keys, buckets)]
            yield from _table(*_names(_KEYS), rows).to_batches()

    return run


def _repeated(buckets: int):
    """Keys that two documents have, dealt to groups of documents."""

    def run(group: pa.Table) -> pa.Table:
        keys = concat(group.column("keys"), np.uint64)
        docs, texts, row = _unpacked(group)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])[: len(keys)]
        at = np.flatnonzero(first)
        out = []
        if len(at):
            own = docs[row][order]
            shared = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
            keep = np.sort(order[shared[np.cumsum(first) - 1]])
            keys, row = keys[keep], row[keep]
            out = [(b, keys[p].tobytes(), *_rows_of(docs, texts, row[p])) for b, p in dealt(_group_of(docs, texts)[row], buckets)]
        return _table(*_names(_KEYS), out)

    return run


def _keys_by_row(group: pa.Table) -> pa.Table:
    keys = concat(group.column("keys"), np.uint64)
    docs, texts, row = _unpacked(group)
    out = [(d, t, keys[p].tobytes()) for d, t, p in _each_row(docs, texts, row)]
    return _table(*_names("doc_key long, text_key long, keys binary"), out)


def _each_row(docs, texts, row):
    order = np.lexsort((texts[row], docs[row]))
    d, t = docs[row][order], texts[row][order]
    cuts = np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(docs[row[part[0]]]), int(texts[row[part[0]]]), part


def _parts(length: int, gram: int, buckets: int):
    """Stretches of each document whose key another document has, dealt by key.

    Of equal stretches in a piece of text the documents after the first are marked at once.
    """

    def run(batches):
        for batch in pieces(batches, "text"):
            data, offsets = bytes_of(batch.column("text"))
            found = _Stretches(data, offsets, length, gram)
            docs, texts = np.asarray(batch.column("doc_key")), np.asarray(batch.column("text_key"))
            bounds = np.searchsorted(found.owner, np.arange(batch.num_rows + 1))
            keep = [a + np.flatnonzero(np.isin(found.keys[a:b], np.frombuffer(k, np.uint64))) for k, a, b in zip(batch.column("keys").to_pylist(), bounds, bounds[1:])]
            keep = np.concatenate(keep) if keep else np.zeros(0, int)
            keys, starts, counts, owner = found.keys[keep], found.starts[keep], found.counts[keep], found.owner[keep]
            same = Rolling(_BYTE[data]).ranges(starts, starts + counts - 1 + length)
            order = np.lexsort((docs[owner], same))
            first = np.concatenate([[True], same[order][1:] != same[order][:-1]])[: len(order)]
            later = np.zeros(len(order), dtype=bool)
            if len(order):
                later[order] = docs[owner][order] != docs[owner][order][first][np.cumsum(first) - 1]
            rows, raw = [], data.tobytes()
            local = starts - offsets[owner]
            for marked in (False, True):
                at = np.flatnonzero(later == marked)
                for bucket, part in dealt(keys[at], buckets):
                    part = at[part]
                    blob = b"" if marked else b"".join([raw[s : s + n] for s, n in zip(starts[part].tolist(), (counts[part] - 1 + length).tolist())])
                    rows.append((bucket, marked, blob, local[part].tobytes(), counts[part].astype(np.int32).tobytes(), *_rows_of(docs, texts, owner[part])))
            yield from _table(*_names(_PARTS), rows).to_batches()

    return run


class Family:
    """Suffix arrays in levels, each of about twice the suffixes of the one below.

    A level has its suffixes in order, cut after ``length`` bytes. A new batch is sorted,
    merge-scanned against each level for equal beginnings, and put in; levels of equal size merge.
    """

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, []

    def suffixes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(data, self.length)
        return np.ascontiguousarray(views[at]).view(f"S{self.length}").ravel()

    def add(self, data: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which suffixes begin as one of a lesser document does; batches come in order of ``docs``."""
        keys = self.suffixes(data, at)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        number = np.cumsum(first) - 1
        hit = docs[order] != np.minimum.reduceat(docs[order], np.flatnonzero(first))[number]
        keys = keys[first]
        known = np.zeros(len(keys), dtype=bool)
        for level in self.levels:
            place = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            known |= level[place] == keys
        hit |= known[number]
        self._put(keys[~known])
        out = np.zeros(len(at), dtype=bool)
        out[order] = hit
        return out

    def _put(self, keys: np.ndarray) -> None:
        # Suffixes that a level has already stay in that one only.
        if len(keys):
            self.levels.append(keys)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            top = self.levels.pop()
            self.levels[-1] = np.sort(np.concatenate([self.levels[-1], top]), kind="stable")


def _match(length: int, buckets: int, batch_size: int):
    """Strings of one bucket that a lesser document has, as runs, dealt to groups of documents."""

    def run(group: pa.Table) -> pa.Table:
        done = group.filter(group.column("marked"))
        seen = group.filter(pc.invert(group.column("marked")))
        data = concat(seen.column("bytes"), np.uint8)
        starts, counts = concat(seen.column("starts"), np.int64), concat(seen.column("counts"), np.int32).astype(np.int64)
        docs, texts, row = _unpacked(seen)
        begins = np.concatenate([[0], np.cumsum(counts - 1 + length)])[:-1] if len(counts) else starts
        order = np.argsort(docs[row], kind="stable")
        # Batches are cut between documents.
        ids, sizes = runs(docs[row][order])
        ends = np.cumsum(sizes)
        strings = np.cumsum(counts[order])
        out_start, out_count, out_row = [], [], []
        family, low = Family(length), 0
        while low < len(order):
            reached = np.searchsorted(strings, (strings[low - 1] if low else 0) + batch_size)
            high = int(ends[min(np.searchsorted(ends, reached, side="right"), len(ends) - 1)])
            part = order[low:high]
            size = counts[part]
            base = np.repeat(np.cumsum(size) - size, size)
            inside = np.arange(int(size.sum())) - base
            hit = family.add(data, np.repeat(begins[part], size) + inside, np.repeat(docs[row[part]], size))
            whose = np.repeat(np.arange(len(part)), size)
            edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (whose[1:] != whose[:-1])]))
            stop = np.flatnonzero(hit & np.concatenate([~hit[1:] | (whose[1:] != whose[:-1]), [True]]))
            out_start.append(starts[part][whose[edge]] + inside[edge])
            out_count.append(stop - edge + 1)
            out_row.append(row[part][whose[edge]])
            low = high
        more_docs, more_texts, more_row = _unpacked(done)
        start = np.concatenate([*out_start, concat(done.column("starts"), np.int64)])
        count = np.concatenate([*out_count, concat(done.column("counts"), np.int32)]).astype(np.int64)
        owner = np.concatenate([*out_row, more_row + len(docs)]).astype(np.int64)
        docs, texts = np.concatenate([docs, more_docs]), np.concatenate([texts, more_texts])
        order = np.argsort(owner, kind="stable")
        start, count, owner = start[order], count[order], owner[order]
        rows = [
            (g, start[p].tobytes(), count[p].astype(np.int32).tobytes(), *_rows_of(docs, texts, owner[p]))
            for g, p in dealt(_group_of(docs, texts)[owner], buckets)
        ]
        return _table(*_names(_SPANS), rows)

    return run


def _spans_by_row(group: pa.Table) -> pa.Table:
    start, count = concat(group.column("starts"), np.int64), concat(group.column("counts"), np.int32).astype(np.int64)
    docs, texts, row = _unpacked(group)
    out = [(d, t, np.stack([start[p], count[p]]).tobytes()) for d, t, p in _each_row(docs, texts, row)]
    return _table(*_names("doc_key long, text_key long, spans binary"), out)


def _apply(length: int, digest: bool):
    def run(batches):
        for batch in pieces(batches, "text"):
            out = []
            for text, spans, copy in zip(*[batch.column(c).to_pylist() for c in ("text", "spans", "copy")]):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                cover = np.zeros(len(raw) + 1, dtype=np.int64)
                if copy and len(raw) >= length:
                    cover[0] = 1
                elif spans:
                    start, count = np.frombuffer(spans, np.int64).reshape(2, -1)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + count - 1 + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                kept = raw[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), [{"start": int(a), "stop": int(b)} for a, b in edge], kept))
            columns = list(zip(*out))
            spans = pa.array(columns[2], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            kept = pa.array([hashlib.sha256(k).hexdigest() for k in columns[3]]) if digest else pa.array(columns[3], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_key"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), spans, kept],
                names=["doc_key", "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def dedup_bytes(
    docs: DataFrame, length: int = LENGTH, *, digest: bool = False, gram: int = GRAM, buckets: int | None = None, batch: int = BATCH
) -> DataFrame:
    """Each document without the strings of ``length`` bytes or more that a lesser one has.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Every byte goes that a string of
    ``length`` bytes covers which also starts in a document with a smaller id; strings are judged on
    the input. Returns doc_id, n_bytes, n_removed, the maximal ``spans`` (byte positions, the stop
    outside) and ``kept``, the bytes left (not always whole characters), or with ``digest`` their SHA-256.

    Equal strings have the same least hash of their ``gram``-byte parts. Of strings in a row with the same
    one the whole stretch goes to that hash's bucket, if two documents have the hash at all. In a bucket
    documents come in batches by id: each batch gets a suffix array, is merge-scanned against the
    levels of the family before, and joins it. Comparisons are of bytes, not of hashes.

    A text that a lesser document has wholly is known by its MD5 and left out of all that. Null and empty
    texts have no bytes and texts under ``length`` keep all. Null ids count as the largest. Rows with
    the same id never mark each other.
    """
    buckets = buckets or bucket_count(text_bytes(docs), BUCKET_BYTES)
    text = F.coalesce("text", F.lit(""))
    # One exchange of the texts serves all three uses.
    base = docs.select(id_key("doc_id").alias("doc_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    twins = docs.select(id_key("doc_id").alias("doc_key"), F.xxhash64(text).alias("text_key"), F.md5(text).alias("twin"))
    least = twins.groupBy("twin").agg(F.min("doc_key").alias("least"))
    copies = twins.join(least, "twin").filter("doc_key > least").select(*_ROW, F.lit(True).alias("copy")).distinct()
    single = base.join(copies, [*_ROW], "left").filter(F.col("copy").isNull()).select(*_ROW, "text")
    # Keys are small: fewer groups of them repeat fewer rows of documents.
    keys = single.mapInArrow(_scan(length, gram, -(-buckets // 4)), _KEYS).groupBy("bucket").applyInArrow(_repeated(buckets), _KEYS)
    keys = keys.groupBy("bucket").applyInArrow(_keys_by_row, "doc_key long, text_key long, keys binary")
    parts = base.join(keys, [*_ROW]).mapInArrow(_parts(length, gram, buckets), _PARTS)
    spans = parts.groupBy("bucket").applyInArrow(_match(length, buckets, batch), _SPANS)
    spans = spans.groupBy("bucket").applyInArrow(_spans_by_row, "doc_key long, text_key long, spans binary")
    joined = base.join(spans, [*_ROW], "left").join(copies, [*_ROW], "left")
    kind = "string" if digest else "binary"
    return joined.select("doc_key", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _apply(length, digest),
        f"doc_key long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept {kind}",
    ).select(F.nullif("doc_key", F.lit(LAST_ID)).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")
