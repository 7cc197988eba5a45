"""Line dedup: a deletion-neighbourhood join finds lines within one edit of an earlier one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.llm.text import (
    _BASE, _BYTE, _SPACE, _UNBASE, Rolling, bucket_count, bytes_of, concat, dealt, id_key, mix, pieces, powers, text_bytes,
)
from resultloom.runtime import materialize

# Lines of fewer characters are not compared by edits; equal ones go from ``least_equal`` characters on.
LEAST_CHARS = 15
PARTS = 4
BUCKET_BYTES = 32 << 20
# Text bytes cut into lines at once: a task holds some 60 times as much in prefix sums.
PIECE_BYTES = 512 << 10

_ROW = ("doc_key", "text_key")


class _Lines:
    """Lines of the texts of a batch that are long enough, trimmed of ASCII white space."""

    def __init__(self, texts: pa.Array, least: int) -> None:
        data, offsets = bytes_of(texts)
        breaks = np.flatnonzero(data == 10)
        # A break at the end of a text begins a line of that text, not of the next.
        at_start = np.concatenate([np.zeros(len(offsets) - 1, bool), np.ones(len(breaks), bool)])
        begins = np.concatenate([offsets[:-1], breaks + 1])
        owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
        order = np.lexsort((at_start, begins, owner))
        begins, owner = begins[order], owner[order]
        first = np.searchsorted(owner, np.arange(len(offsets) - 1))
        self.number = np.arange(len(begins)) - first[owner] if len(owner) else owner
        ends = np.concatenate([begins[1:] - 1, [0]])[: len(begins)]
        last = np.concatenate([owner[1:] != owner[:-1], [True]])[: len(begins)]
        ends[last] = offsets[1:][owner[last]]
        solid = np.flatnonzero(~_SPACE[data])
        low, high = np.searchsorted(solid, begins), np.searchsorted(solid, ends)
        full = low < high
        self.starts, self.ends = solid[low[full]], solid[high[full] - 1] + 1
        self.owner, self.number = owner[full], self.number[full]
        chars = (data & 0xC0) != 0x80
        self.before = np.concatenate([[0], np.cumsum(chars)])
        self.chars = np.append(np.flatnonzero(chars), len(data))
        self.data = data
        self.length = self.before[self.ends] - self.before[self.starts]
        keep = self.length >= least
        for name in ("starts", "ends", "owner", "number", "length"):
            setattr(self, name, getattr(self, name)[keep])
        self.rolling = Rolling(_BYTE[data])
        self.hashes = self.rolling.ranges(self.starts, self.ends)

    def keys(self) -> list[tuple[int, int, np.ndarray]]:
        """(longer by, part, hash): equal for lines that differ by an edit inside that part.

        A line of m characters is cut into parts; one that it turns into by one edit, of m or
        m + 1 characters, has all before and after the edited part. So a line has keys as the
        shorter (longer by 0) and as the longer of two (by 1).
        """
        first, out = self.before[self.starts], []
        for longer in (0, 1):
            m = self.length - longer
            for part in range(PARTS):
                low, high = m * part // PARTS, m * (part + 1) // PARTS
                head = self.rolling.ranges(self.starts, self.chars[first + low])
                tail = self.rolling.ranges(self.chars[first + self.length - (m - high)], self.ends)
                out.append((longer, part, mix(head + mix(tail) + m.astype(np.uint64), 11 + part)))
        return out


def _scan(least: int):
    def run(batches):
        for batch in pieces(batches, "text", PIECE_BYTES):
            lines = _Lines(batch.column("text"), least)
            take = pa.array(lines.owner)
            yield pa.record_batch(
                [pa.array(lines.hashes.view(np.int64)), batch.column("doc_key").take(take), batch.column("text_key").take(take), pa.array(lines.number, pa.int64())],
                names=["hash", *_ROW, "line"],
            )

    return run


_KEYS = "bucket int, keys binary, hashes binary, parts binary"


def _packed(names: list[str], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=names)


def _scan_keys(least: int, buckets: int):
    def run(batches):
        for batch in pieces(batches, "text", PIECE_BYTES):
            lines, rows = _Lines(batch.column("text"), least), []
            _, once = np.unique(lines.hashes, return_index=True)
            found = lines.keys()
            keys, hashes = np.concatenate([k[once] for _, _, k in found]), np.tile(lines.hashes[once], len(found))
            parts = np.repeat(np.array([longer * PARTS + part for longer, part, _ in found], np.int8), len(once))
            for bucket, at in dealt(keys, buckets):
                rows.append((bucket, keys[at].tobytes(), hashes[at].tobytes(), parts[at].tobytes()))
            yield from _packed(["bucket", "keys", "hashes", "parts"], rows).to_batches()

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Lines whose key another line of the bucket has."""
    keys, hashes = concat(group.column("keys"), np.uint64), concat(group.column("hashes"), np.uint64)
    parts = concat(group.column("parts"), np.int8)
    order = np.lexsort((hashes, keys))
    keys, hashes, parts = keys[order], hashes[order], parts[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    number = np.cumsum(first) - 1
    least, most = hashes[first], hashes[np.append(np.flatnonzero(first)[1:], len(keys)) - 1] if len(keys) else hashes
    meets = least[number] != most[number] if len(keys) else first
    return pa.table([pa.array(hashes[meets].view(np.int64)), pa.array(parts[meets])], names=["hash", "part"])


def _texts(batches):
    """Text of the chosen lines of each document."""
    for batch in pieces(batches, "text"):
        for text, chosen in zip(batch.column("text").to_pylist(), batch.column("chosen").to_pylist()):
            lines = text.split("\n")
            yield pa.record_batch([
                pa.array([c["hash"] for c in chosen]), pa.array([c["parts"] for c in chosen], pa.list_(pa.int8())),
                pa.array([lines[c["line"]].strip(" \t\n\x0b\x0c\r") for c in chosen]),
            ], names=["hash", "parts", "line_text"])


def _variants(buckets: int):
    """Deletion variants of each line as hashed keys, with the line and its place."""

    def run(batches):
        for batch in batches:
            keys, owner, kinds = [], [], []
            for row, (text, parts) in enumerate(zip(batch.column("line_text").to_pylist(), batch.column("parts").to_pylist())):
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
                size = len(points)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points, 5) * powers(_BASE, size))])
                for part in parts:
                    longer, number = divmod(part, PARTS)
                    m = size - longer
                    at = np.arange(m * number // PARTS, m * (number + 1) // PARTS + longer)
                    # The hash of the line without character ``at``: what follows moves up by one.
                    without = sums[at] + (sums[size] - sums[at + 1]) * np.uint64(_UNBASE)
                    if longer:
                        own, kind = mix(without, 21), 2
                    else:
                        # Same place, other character: the place is part of the key.
                        own, kind = mix(without + mix(at.astype(np.uint64), 22), 23), 0
                        keys.append(mix(sums[size : size + 1], 21))
                        owner.append([row])
                        kinds.append([1])
                    keys.append(own)
                    owner.append(np.full(len(own), row))
                    kinds.append(np.full(len(own), kind))
            if not keys:
                continue
            keys, owner, kinds = np.concatenate(keys), np.concatenate(owner).astype(np.int64), np.concatenate(kinds).astype(np.int8)
            hashes, ranks = np.asarray(batch.column("hash")), np.asarray(batch.column("rank"))
            rows = []
            for bucket, part in dealt(keys, buckets):
                rows.append((bucket, keys[part].tobytes(), hashes[owner[part]].tobytes(), ranks[owner[part]].tobytes(), kinds[part].tobytes()))
            yield from _packed(["bucket", "keys", "hashes", "ranks", "kinds"], rows).to_batches()

    return run


def _meet(group: pa.Table) -> pa.Table:
    """(hash, earlier): each line with the earliest one that a key joins it to, if that is earlier."""
    keys, hashes = concat(group.column("keys"), np.uint64), concat(group.column("hashes"), np.int64)
    ranks, kinds = concat(group.column("ranks"), np.int64), concat(group.column("kinds"), np.int8)
    found = []
    # Lines with one key as substitutions are one edit apart, all of them. A whole line (1) is one
    # edit from the longer ones (2) that have it as a variant; these need not be near each other.
    for mine, other in ((0, 0), (1, 2), (2, 1)):
        order = np.lexsort((ranks, keys, kinds != other))[: int((kinds == other).sum())]
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])[: len(order)]
        known, holder = keys[order][first], order[first]
        ask = np.flatnonzero(kinds == mine)
        at = np.searchsorted(known, keys[ask])
        hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == keys[ask])) if len(known) else np.zeros(0, int)
        best = holder[at[hit]]
        earlier = (ranks[best] < ranks[ask[hit]]) & (hashes[best] != hashes[ask[hit]])
        found.append(np.stack([hashes[ask[hit]][earlier], hashes[best][earlier]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hash", "earlier"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(id_key("doc_id").alias("doc_key"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))


def near_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_equal: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(lines, gone): every line of ``least_equal`` characters by place, and what is known of each distinct one.

    ``gone`` has (hash, place, near): its first place, and whether a line within one edit,
    and not equal, stands before that.
    """
    keyed = _keyed(docs)
    total = text_bytes(keyed)
    buckets = bucket_count(total, BUCKET_BYTES)
    lines = keyed.mapInArrow(_scan(least_equal), "hash long, doc_key long, text_key long, line long")
    first = materialize(lines.groupBy("hash").agg(F.min(F.struct(*_ROW, "line")).alias("place")), "lines")
    # A pair of lines one edit apart has equal text around the edit: others need no variants.
    keys = keyed.mapInArrow(_scan_keys(least_chars, buckets), _KEYS)
    chosen = keys.groupBy("bucket").applyInArrow(_shared, "hash long, part byte").groupBy("hash").agg(F.collect_set("part").alias("parts"))
    placed = chosen.join(first, "hash").select("hash", "parts", "place.*")
    wanted = placed.groupBy(*_ROW).agg(F.collect_list(F.struct("hash", "line", "parts")).alias("chosen"))
    texts = keyed.join(wanted, [*_ROW]).select("text", "chosen").mapInArrow(_texts, "hash long, parts array<byte>, line_text string")
    texts = materialize(texts.dropDuplicates(["hash"]).join(first, "hash"), "candidates")
    # Places in order, as one number: slices by range, each numbered on its own.
    ranked = _ranked(texts)
    variants = ranked.select("hash", "parts", "line_text", "rank").mapInArrow(
        _variants(buckets), "bucket int, keys binary, hashes binary, ranks binary, kinds binary"
    )
    pairs = variants.groupBy("bucket").applyInArrow(_meet, "hash long, earlier long").distinct()
    mine = texts.select("hash", F.col("line_text").alias("a"))
    theirs = texts.select(F.col("hash").alias("earlier"), F.col("line_text").alias("b"))
    near = pairs.join(mine, "hash").join(theirs, "earlier").filter(F.levenshtein("a", "b", 1) >= 0).select("hash").distinct()
    return lines, first.join(near.withColumn("near", F.lit(True)), "hash", "left").withColumn("near", F.coalesce("near", F.lit(False)))


def _ranked(texts: DataFrame) -> DataFrame:
    """``texts`` with ``rank``: numbers in the order of places, distinct and with gaps."""
    sliced = materialize(
        texts.repartitionByRange(F.col("place")).sortWithinPartitions("place").withColumn("rank", F.monotonically_increasing_id()), "ranks"
    )
    return sliced


def line_decisions(docs: DataFrame, least_chars: int = LEAST_CHARS, least_equal: int = LEAST_CHARS) -> DataFrame:
    """(doc_key, text_key, removed): numbers of the lines that go, for documents that lose some."""
    lines, known = near_lines(docs, least_chars, least_equal)
    place = F.struct(*[F.col(c) for c in (*_ROW, "line")])
    # Many equal lines meet one row: they are the left side, which Spark splits when it is skewed.
    going = lines.join(known, "hash").filter(F.col("near") | (place != F.col("place")))
    return going.groupBy(*_ROW).agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _decided(docs: DataFrame, least_chars: int, least_equal: int) -> DataFrame:
    """``docs`` as the struct ``row``, with n_lines and the numbers of the lines that go."""
    going = line_decisions(docs, least_chars, least_equal)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_key("doc_id").alias("doc_key"), F.xxhash64("text").alias("text_key"),
        F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long").alias("n_lines"),
    )
    return rows.join(going, [*_ROW], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))


def dedup_lines(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_equal: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, removed) of each row of ``docs``: the numbers of the lines that go.

    Lines are separated by newlines and compared without white space around them. A line of
    ``least_equal`` characters or more goes if an equal one stands before it, one of ``least_chars``
    or more also if one of that length within one edit (a character more, fewer or other) does: in a
    document with a smaller id or higher up in the same. ``least_equal`` is at most ``least_chars``;
    1 compares all lines but blank ones. All is judged on the input, so of a chain of edits only the first line stays.

    Each line that shares all but a quarter of its text with another emits its deletion variants
    in that quarter as hashed keys; equal keys are joined, each line to the earliest it meets, and
    the edit distance of the two is checked. A null or empty text has no lines and shorter lines stay.
    Null ids count as the largest. Rows with the same id and text are one document, each keeps the
    same lines; rows with one id and different texts stand in the order of their text's hash.
    """
    return _decided(docs, least_chars, least_equal).select("row.doc_id", "n_lines", "removed")


def _cut(batches):
    """The rows with their texts without the removed lines."""
    for batch in pieces(batches, "text"):
        kept = []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            if removed:
                lines = np.array(text.split("\n"), dtype=object)
                text = "\n".join(np.delete(lines, removed))
            kept.append(text)
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.record_batch([*[batch.column(n) for n in rest], pa.array(kept, pa.string())], names=[*rest, "text"])


def clean_lines(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_equal: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the lines that ``dedup_lines`` names taken out of the texts.

    All columns stay; ``n_chars``, if there, counts anew for changed texts. A document
    that had a line and has none but blank ones left is dropped: all it said is
    said before. Texts that were null or blank already stay.
    """
    rest = F.struct(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"])
    decided = _decided(docs, least_chars, least_equal).select(rest.alias("row"), "removed", F.col("row.text").alias("text"))
    done = decided.mapInArrow(_cut, decided.schema)
    changed = F.size("removed") > 0
    done = done.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        counted = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType))
        own["n_chars"] = counted.otherwise(F.col("row.n_chars"))
    return done.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
