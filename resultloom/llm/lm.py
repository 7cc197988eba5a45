"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.llm.text import (
    Rolling, Words, bucket_count, bytes_of, concat, dealt, bucket_of, lower_ascii, mix, pieces, text_bytes,
)
from resultloom.runtime import materialize

ORDER = 2
# Counts are held as powers of this base.
BASE = 2.0
BITS_PER_ENTRY, PROBES = 10, 5
# Weight of the lower order, as a count.
PRIOR = 100.0
# Filter bytes that one pass over the texts broadcasts.
FILTER_BYTES = 128 << 20
# Tokens this frequent have their exact counts broadcast: at most so many can exist.
FREQUENT = 1_000_000
BUCKET_BYTES = 8 << 20
PIECE_BYTES = 1 << 20

_END, _BEGIN = np.uint64(0x5EED0E4D), np.uint64(0x5EEDBE61)
_SLICE = "order int, bucket int, entries long, bits long, filter binary, hashes binary, counts binary, total long"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, splits): the words of each text in lower case A-Z, then one end."""
    data, offsets = bytes_of(texts)
    words = Words(lower_ascii(data), offsets)
    splits = words.splits + np.arange(len(words.splits))
    out = np.full(splits[-1], mix(np.array([_END]))[0])
    inside = np.ones(len(out), dtype=bool)
    inside[splits[1:] - 1] = False
    out[inside] = words.hashes
    return out, splits


def ngrams(hashes: np.ndarray, splits: np.ndarray, order: int) -> np.ndarray:
    """For each token the hash of the n-gram of ``order`` tokens that ends there; a begin mark fills up."""
    if order == 1:
        return mix(hashes, 31)
    grams, at = hashes.copy(), np.arange(len(hashes))
    first = np.repeat(splits[:-1], np.diff(splits))
    for back in range(1, order):
        before = np.where(at - back >= first, hashes[np.maximum(at - back, 0)], _BEGIN)
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + mix(before, back)
    return mix(grams, 31 + order)


def quantised(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count)); the count that a level stands for is base ** (level - 1)."""
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def _positions(grams: np.ndarray, level: np.ndarray | int, probe: int, bits: np.ndarray) -> np.ndarray:
    """Bit of an entry (n-gram, level) for one of its probes, inside its bucket's slice."""
    mixed = mix(grams + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 41 + probe)
    return ((mixed >> np.uint64(32)) * bits >> np.uint64(32)).astype(np.int64)


def _fill(grams: np.ndarray, levels: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The slice of the filter that holds every n-gram with all levels up to its own."""
    out = np.zeros(bits // 8, dtype=np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = grams[levels >= level]
        for probe in range(probes):
            at = _positions(own, level, probe, np.uint64(bits))
            np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out


@dataclass
class Filter:
    """Slices of a log-frequency Bloom filter (Talbot and Osborne, 2007), one per bucket of n-grams."""

    data: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    probes: int

    def levels(self, grams: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The level of each n-gram: membership is probed level by level until one is missing."""
        out = np.zeros(len(grams), dtype=np.uint8)
        left = np.flatnonzero(self.bits[buckets] > 0)
        level = 0
        while len(left) and level < 255:
            level += 1
            for probe in range(self.probes):
                slices = buckets[left]
                at = _positions(grams[left], level, probe, self.bits[slices].astype(np.uint64))
                left = left[(self.data[self.starts[slices] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
            out[left] = level
        return out


def _scan(order: int, buckets: int):
    """Counts of n-grams of all orders in a piece of text, dealt to buckets."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE_BYTES):
            hashes, splits = tokens(batch.column("text"))
            rows = []
            for n in range(1, order + 1):
                # Of single tokens the hash itself is kept, as exact counts are looked up by it.
                grams = hashes if n == 1 else ngrams(hashes, splits, n)
                found, counts = np.unique(grams, return_counts=True)
                for bucket, part in dealt(mix(found, 31) if n == 1 else found, buckets):
                    rows.append((n, bucket, found[part].tobytes(), counts[part].astype(np.uint32).tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.record_batch(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                names=["order", "bucket", "hashes", "counts"],
            )

    return run


def _slices(base: float, bits_per_entry: int, probes: int):
    """One bucket's counts added up, as a slice of the filter; for single tokens also as they are."""

    def run(group: pa.Table) -> pa.Table:
        order, bucket = group.column("order")[0].as_py(), group.column("bucket")[0].as_py()
        hashes, counts = concat(group.column("hashes"), np.uint64), concat(group.column("counts"), np.uint32)
        found, place = np.unique(hashes, return_inverse=True)
        totals = np.bincount(place, counts, minlength=len(found)).astype(np.int64)
        levels = quantised(totals, base)
        entries = int(levels.sum())
        bits = max(64, -(-entries * bits_per_entry // 64) * 64)
        data = _fill(mix(found, 31) if order == 1 else found, levels, bits, probes)
        own = (found.tobytes(), totals.tobytes()) if order == 1 else (b"", b"")
        row = [order, bucket, len(found), bits, data.tobytes(), *own, int(totals.sum())]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        names = [x.split()[0] for x in _SLICE.split(", ")]
        return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=names)

    return run


@dataclass
class Model:
    """Slices of the filter and exact token counts as a written table, and the sums that are numbers."""

    table: DataFrame
    buckets: int
    order: int
    base: float
    probes: int
    texts: int
    total: int
    distinct: int
    filter_bytes: int


def train(
    docs: DataFrame, *, order: int = ORDER, base: float = BASE, bits_per_entry: int = BITS_PER_ENTRY, probes: int = PROBES,
    buckets: int | None = None,
) -> Model:
    """Count all n-grams of up to ``order`` tokens in ``docs`` and write the filter's slices.

    A bucket is a range of hashes; its slice has ``bits_per_entry`` bits for each (n-gram, level).
    An n-gram that many texts share leaves a task once per piece of text.
    """
    buckets = buckets or bucket_count(text_bytes(docs), BUCKET_BYTES)
    counted = docs.select("text").mapInArrow(_scan(order, buckets), "order int, bucket int, hashes binary, counts binary")
    table = materialize(counted.groupBy("order", "bucket").applyInArrow(_slices(base, bits_per_entry, probes), _SLICE), "filter")
    sums = table.agg(
        F.sum(F.when(F.col("order") == 1, F.col("entries"))).alias("distinct"), F.sum(F.when(F.col("order") == 1, F.col("total"))).alias("total"),
        F.sum(F.col("bits") / 8).alias("bytes"),
    ).first()
    return Model(table, buckets, order, base, probes, docs.count(), int(sums.total or 0), int(sums.distinct or 0), int(sums.bytes or 0))


def _gathered(model: Model, slices: DataFrame) -> list[tuple]:
    """Filters by order, from the slices of one round, as plain arrays; slices come one partition at a time."""
    sizes = np.zeros((model.order, model.buckets), dtype=np.int64)
    for r in slices.select("order", "bucket", "bits").collect():
        sizes[r.order - 1, r.bucket] = r.bits
    starts = np.cumsum(sizes // 8, axis=1) - sizes // 8
    data = [np.zeros(max(1, int(own.sum()) // 8), dtype=np.uint8) for own in sizes]
    for r in slices.select("order", "bucket", "filter").toLocalIterator():
        at = starts[r.order - 1, r.bucket]
        data[r.order - 1][at : at + len(r["filter"])] = np.frombuffer(r["filter"], np.uint8)
    return list(zip(data, starts, sizes))


def _probe(texts: pa.Array, filters: list[Filter], order: int, buckets: int) -> np.ndarray:
    """Level of the n-gram that ends at each token, a row per order; one probing per distinct n-gram."""
    hashes, splits = tokens(texts)
    out = np.zeros((order, len(hashes)), dtype=np.uint8)
    for n in range(1, order + 1):
        grams, place = np.unique(ngrams(hashes, splits, n), return_inverse=True)
        out[n - 1] = filters[n - 1].levels(grams, bucket_of(grams, buckets))[place]
    return out


def _log_probabilities(levels: np.ndarray, splits: np.ndarray, model: dict) -> np.ndarray:
    """Sum of log10 p per text: each order's share of its context, the lower order as prior.

    The count of a context is never taken smaller than that of an n-gram it begins.
    """
    counts = np.where(levels > 0, model["base"] ** (levels.astype(float) - 1), 0.0)
    p = (counts[0] + 1) / (model["top"] + model["distinct"] + 1)
    for n in range(2, len(levels) + 1):
        # The context of an n-gram is the n-gram of one order less that ends a token before.
        context = np.concatenate([[0.0], counts[n - 2][:-1] * model["base"]])
        context[splits[:-1][np.diff(splits) > 0]] = model["texts"]
        p = (counts[n - 1] + PRIOR * p) / (np.maximum(context, counts[n - 1]) + PRIOR)
    logs = np.log10(np.minimum(p, 1.0))
    sums = np.concatenate([[0.0], np.cumsum(logs)])
    return sums[splits[1:]] - sums[splits[:-1]]


_OUT = "doc_id long, text_key long, n_tokens long, score double, base double, known long, rare_hash array<long>, rare_count array<long>"


def _score(rounds: int, handle, common, model: dict):
    """Scores of each text, base sums of its frequent tokens, and its rare tokens with their numbers.

    With several rounds the levels of the earlier ones come along as bytes.
    """

    def run(batches):
        filters = [Filter(*x, model["probes"]) for x in handle.value]
        known_hash, known_count = common.value
        for batch in pieces(batches, "text", PIECE_BYTES):
            texts = batch.column("text")
            levels = _probe(texts, filters, model["order"], model["buckets"])
            if rounds > 1:
                earlier = concat(pa.chunked_array([batch.column("levels")]), np.uint8)
                levels = np.maximum(levels, _unpacked(earlier, levels.shape, tokens(texts)[1]))
            hashes, splits = tokens(texts)
            score = _log_probabilities(levels, splits, model)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(splits))
            at = np.minimum(np.searchsorted(known_hash, hashes), max(0, len(known_hash) - 1))
            common_here = known_hash[at] == hashes if len(known_hash) else np.zeros(len(hashes), bool)
            logs = np.where(common_here, np.log10((known_count[at] if len(known_count) else 0) + 1.0), 0.0)
            base = np.bincount(owner, logs, minlength=batch.num_rows)
            known = np.bincount(owner, common_here, minlength=batch.num_rows).astype(np.int64)
            rare = np.flatnonzero(~common_here)
            order = rare[np.lexsort((hashes[rare], owner[rare]))]
            h, o = hashes[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])[: len(h)])
            times = np.diff(np.append(first, len(h)))
            cuts = pa.array(np.searchsorted(o[first], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(splits).astype(np.int64)), pa.array(score), pa.array(base),
                 pa.array(known), pa.ListArray.from_arrays(cuts, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64)))],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )

    return run


def _packed(levels: np.ndarray, splits: np.ndarray) -> list[bytes]:
    return [levels[:, a:b].tobytes() for a, b in zip(splits, splits[1:])]


def _unpacked(data: np.ndarray, shape, splits: np.ndarray) -> np.ndarray:
    out = np.zeros(shape, np.uint8)
    for a, b in zip(splits, splits[1:]):
        out[:, a:b] = data[a * shape[0] : b * shape[0]].reshape(shape[0], b - a)
    return out


def _round(handle, first: bool, model: dict):
    """Levels that this round's slices give, the larger of them and the earlier ones."""

    def run(batches):
        filters = [Filter(*x, model["probes"]) for x in handle.value]
        for batch in pieces(batches, "text", PIECE_BYTES):
            levels = _probe(batch.column("text"), filters, model["order"], model["buckets"])
            splits = tokens(batch.column("text"))[1]
            if not first:
                earlier = concat(pa.chunked_array([batch.column("levels")]), np.uint8)
                levels = np.maximum(levels, _unpacked(earlier, levels.shape, splits))
            own = batch.select(["doc_id", "text_key", "text"]).columns
            yield pa.RecordBatch.from_arrays([*own, pa.array(_packed(levels, splits), pa.binary())], names=["doc_id", "text_key", "text", "levels"])

    return run


def score(docs: DataFrame, model: Model, *, filter_bytes: int = FILTER_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of ``docs`` (doc_id, text).

    ``score`` is the log10 probability of the text's tokens and end. Counts are read from the
    filter by repeated membership probes and an n-gram's probability is interpolated with that of
    the next lower order: (c(h w) + k p(w | h')) / (c(h) + k). ``base_score`` has the exact counts c
    of single tokens: the sum of log10((c + 1) / (N + V + 1)); ``n_known`` tokens have c > 0.

    The filter goes to the workers in rounds of at most ``filter_bytes``, whatever its size, one pass
    over the texts each; between rounds the levels found are written. Exact counts of tokens
    that are at least a ``frequent``-th part of all are broadcast: no more than ``frequent`` of them can
    exist. The others are joined, each with its number per text.

    A null text is empty: its only token is the end. Rows with one id and text have equal results,
    each in a row of its own; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    rounds = max(1, -(-model.filter_bytes // filter_bytes))
    plain = {k: getattr(model, k) for k in ("order", "base", "probes", "buckets", "distinct", "texts")}
    # Levels stand for counts of up to ``base`` times as much: all together stay under the total.
    plain["top"] = model.total
    part = F.pmod(F.xxhash64("order", "bucket"), F.lit(rounds))
    for number in range(rounds - 1):
        handle = context.broadcast(_gathered(model, model.table.filter(part == number)))
        rows = materialize(rows.mapInArrow(_round(handle, number == 0, plain), "doc_id long, text_key long, text string, levels binary"), "levels")
    handle = context.broadcast(_gathered(model, model.table.filter(part == rounds - 1)))
    counts = model.table.filter("order = 1").select("hashes", "counts").mapInArrow(_unpack_counts, "hash long, count long")
    least = max(2, -(-model.total // frequent))
    common = counts.filter(F.col("count") >= least).toArrow()
    common_hash, common_count = (common.column(c).to_numpy().astype(np.int64) for c in ("hash", "count"))
    order = np.argsort(common_hash.view(np.uint64))
    common = context.broadcast((common_hash.view(np.uint64)[order], common_count[order]))
    scored = rows.mapInArrow(_score(rounds, handle, common, plain), _OUT)
    # A row for each text and one for each of its rare tokens, in one pass.
    rare = F.arrays_zip(F.col("rare_hash").alias("hash"), F.col("rare_count").alias("n"))
    own = F.array(F.struct(F.col("text_key").alias("hash"), F.lit(0).cast("long").alias("n")))
    parts = scored.select("doc_id", "text_key", "n_tokens", "score", "base", "known", F.explode(F.concat(own, rare)).alias("t"))
    head = F.col("t.n") == 0
    parts = parts.select(
        "doc_id", "text_key", F.col("t.hash").alias("hash"), F.col("t.n").alias("n"), head.cast("long").alias("copies"),
        *[F.when(head, F.col(c)).alias(c) for c in ("n_tokens", "score", "base", "known")],
    )
    met = parts.join(counts.filter(F.col("count") < least), "hash", "left")
    c = F.when(F.col("n") > 0, F.coalesce("count", F.lit(0)))
    done = met.groupBy("doc_id", "text_key").agg(
        F.sum("copies").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"), F.max("base").alias("base"), F.max("known").alias("known"),
        F.sum(F.col("n") * F.log10(c + 1.0)).alias("rare_base"), F.sum(F.when(c > 0, F.col("n"))).alias("rare_known"),
    )
    floor = math.log10(model.total + model.distinct + 1)
    # Equal rows were added up together.
    return done.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0)) / F.col("copies")).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) / F.col("copies") - F.col("n_tokens") * floor).alias("base_score"), "score",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def _unpack_counts(batches):
    for batch in batches:
        for hashes, counts in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.record_batch([pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["hash", "count"])
