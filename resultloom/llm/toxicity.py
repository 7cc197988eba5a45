"""Toxicity of texts: a linear classifier on character n-grams scaled by log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.llm.text import mix, pieces

LENGTHS = (3, 4, 5)
DIMENSIONS = 1 << 19
# Labelled rows that the classifier is fitted on at most: those with the least hash of their id.
TRAIN_ROWS = 20_000
# Features kept: log-count ratio at least so large, and counts so many standard deviations
# from what the class sizes let expect.
MIN_RATIO, MIN_DEVIATION = 1.0, 6.0
FEATURES = 1 << 15
THRESHOLD = 0.3
_BLOCK = 1 << 15


def grams(texts: list[str | None], lengths=LENGTHS, dimensions: int = DIMENSIONS):
    """(text number, feature) of each character n-gram, one array pair per length.

    Letters are lowered; every run of white space is one space, and each text has one at
    either end, so that an n-gram can tell a word from a part of one.
    """
    folded = [" " + " ".join((t or "").lower().split()) + " " for t in texts]
    sizes = np.array([len(t) for t in folded])
    points = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(folded), dtype=np.int32), sizes)
    rolled = mix(points, 3)
    for length in range(2, max(lengths) + 1):
        step = mix(points[length - 1 :], 3)
        rolled = rolled[: len(step)] * np.uint64(0x9E3779B97F4A7C15) + step
        if length in lengths:
            inside = owner[: len(step)] == owner[length - 1 :]
            feature = (mix(rolled, length) >> np.uint64(64 - (dimensions.bit_length() - 1))).astype(np.int32)
            yield owner[: len(step)][inside], feature[inside]


@dataclass
class Model:
    """Weights of the kept features (zero elsewhere) and the bias."""

    weights: np.ndarray
    bias: float
    lengths: tuple = LENGTHS
    kept: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.kept = self.weights != 0

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature) once for each kept feature that a text has."""
        return present(texts, self.kept, self.lengths)

    def score(self, texts: list[str | None]) -> np.ndarray:
        owner, feature = self.present(texts)
        total = self.bias + np.bincount(owner, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def present(texts, kept: np.ndarray, lengths=LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for owner, feature in grams(texts, lengths, len(kept)):
        hit = kept[feature]
        found.append(owner[hit].astype(np.int64) * len(kept) + feature[hit])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // len(kept), keys % len(kept)


def _counts(lengths, dimensions):
    """Feature counts of either class in a partition, one row per block of features."""

    def run(batches):
        total = np.zeros((2, dimensions), dtype=np.int64)
        for batch in pieces(batches, "text"):
            toxic = np.asarray(batch.column("toxic"))
            for owner, feature in grams(batch.column("text").to_pylist(), lengths, dimensions):
                for label in (0, 1):
                    total[label] += np.bincount(feature[toxic[owner] == label], minlength=dimensions)
        if total.any():
            step = min(_BLOCK, dimensions)
            blocks = range(0, dimensions, step)
            yield pa.record_batch(
                [pa.array(range(len(blocks)), pa.int32()), *[pa.array([total[k, b : b + step].tobytes() for b in blocks]) for k in (0, 1)]],
                names=["block", "clean", "toxic"],
            )

    return run


def _add_up(group: pa.Table) -> pa.Table:
    sums = [np.sum([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()], axis=0).tobytes() for c in ("clean", "toxic")]
    return pa.table([group.column("block").slice(0, 1), pa.array([sums[0]]), pa.array([sums[1]])], names=["block", "clean", "toxic"])


def _examples(kept, lengths):
    def run(batches):
        for batch in pieces(batches, "text"):
            owner, feature = present(batch.column("text").to_pylist(), kept.value, lengths)
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            blobs = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.record_batch([batch.column("toxic"), pa.array(blobs, pa.binary())], names=["toxic", "features"])

    return run


def _descend(features: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, steps: int = 300, penalty: float = 1.0):
    """Logistic regression on presence times ratio, by Adam on all examples at once."""
    used, column = np.unique(np.concatenate(features), return_inverse=True)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    scale = ratio[used][column]
    weight, bias = np.zeros(len(used)), np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        total = bias + np.bincount(row, scale * weight[column], minlength=len(features))
        error = 1 / (1 + np.exp(-np.clip(total, -500, 500))) - toxic
        slope = np.bincount(column, scale * error[row], minlength=len(used)) / len(toxic) + penalty * weight / len(toxic)
        slope = np.append(slope, error.mean())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    out = np.zeros(len(ratio))
    out[used] = weight * ratio[used]
    return out, float(bias)


def train(
    docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, lengths=LENGTHS, dimensions: int = DIMENSIONS
) -> Model:
    """Fit the classifier (Wang and Manning, 2012) to ``labels`` (doc_id, toxic).

    It is fitted to at most ``rows`` labelled documents, those with the least hash of
    their id; a document with several labels, or a text with several documents, counts once, as toxic
    if one label says so; null labels and ids are left out. Counts of the hashed n-grams per class give the log-count
    ratios; the features of largest ratio are kept, and logistic regression weighs them.
    Without examples of both classes each text scores the toxic share of the examples, 0 if there are none.
    """
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    )
    # At most ``rows`` rows of two numbers: a bound that does not grow with the data.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    blocks = (
        sample.mapInArrow(_counts(lengths, dimensions), "block int, clean binary, toxic binary")
        .groupBy("block").applyInArrow(_add_up, "block int, clean binary, toxic binary").collect()
    )
    counts = np.zeros((2, dimensions))
    step = min(_BLOCK, dimensions)
    for block in blocks:
        for k, name in enumerate(("clean", "toxic")):
            counts[k, block.block * step : (block.block + 1) * step] = np.frombuffer(block[name], np.int64)
    logs = np.log(counts + 1) - np.log((counts + 1).sum(axis=1, keepdims=True))
    ratio = logs[1] - logs[0]
    seen, share = counts.sum(axis=0), counts[1].sum() / max(1, counts.sum())
    deviation = np.abs(counts[1] - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    strong = np.where((np.abs(ratio) >= MIN_RATIO) & (deviation >= MIN_DEVIATION), deviation, 0)
    kept = np.zeros(dimensions, dtype=bool)
    best = np.argsort(-strong, kind="stable")[:FEATURES]
    kept[best[strong[best] > 0]] = True
    spark = docs.sparkSession
    handle = spark.sparkContext.broadcast(kept)
    found = sample.mapInArrow(_examples(handle, lengths), "toxic long, features binary").collect()
    toxic = np.array([x.toxic for x in found], dtype=float)
    if not len(found) or toxic.min() == toxic.max() or not kept.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        bias = float(np.clip(np.log(max(share, 1e-300) / max(1 - share, 1e-300)), -500, 500))
        return Model(np.zeros(dimensions), bias, tuple(lengths))
    order = sorted(range(len(found)), key=lambda i: (bytes(found[i].features), toxic[i]))
    weights, bias = _descend([np.frombuffer(found[i].features, np.int32) for i in order], toxic[order], ratio)
    return Model(weights, bias, tuple(lengths))


def _score(weights, bias, lengths):
    def run(batches):
        model = Model(weights.value, bias, lengths)
        for batch in pieces(batches, "text"):
            score = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "_score"])

    return run


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the probability that the label is 1; null and blank texts get one too."""
    columns = docs.columns
    # Positions for names: two columns of a table may have the same.
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = columns.index("text")
    plain = plain.withColumnRenamed(f"c{at}", "text")
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(_score(weights, model.bias, model.lengths), f"{schema}, _score double").toDF(*columns, out)


def held_out(doc_id, parts: int, part: int = 2):
    """Rows kept from learning: CRC-32 of the id as text, by remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))
