"""Titles near each other by their characters, compared in blocks of similar length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.functions.similarity import Texts, common_lengths
from resultloom.operators.components import least_reachable
from resultloom.operators.skew import position
from resultloom.runtime import materialize

# Titles of a block, kinds of characters that are counted, and pairs compared at once. They bound a task, not the answer.
BLOCK, KINDS, PAIRS = 512, 64, 4096


def _alike(texts: list[str], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of word sets score the threshold by the characters of their rests (see ``WordSets``)."""
    out = np.zeros(len(a), bool)
    for low in range(0, len(a), PAIRS):
        rests, shared = ([], []), []
        for i, j in zip(a[low : low + PAIRS].tolist(), b[low : low + PAIRS].tolist()):
            left, right = texts[i].split(" "), texts[j].split(" ")
            in_left, in_right = set(left), set(right)
            rests[0].append(" ".join([w for w in left if w not in in_right]))
            rests[1].append(" ".join([w for w in right if w not in in_left]))
            both = [w for w in left if w in in_right]
            shared.append(len(" ".join(both)) + 1 if both else 0)
        sizes = np.array([list(map(len, rest)) for rest in rests]).sum(axis=0)
        distance = sizes - 2 * common_lengths(*rests)
        out[low : low + PAIRS] = 100.0 - 100.0 * distance / (2 * np.array(shared) + sizes) >= threshold * 100
    return out


def _candidates(table: pa.Table, texts: list[str], threshold: float, gap: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the two blocks of a group that their counts of characters let match, nearest first.

    An edit changes one count by one, so edits are at least as many as the counts differ in sum,
    also when several characters share a count.
    """
    own = Texts(texts)
    n = len(texts)
    counts = np.bincount(np.repeat(np.arange(n), own.sizes) * KINDS + own.points % KINDS, minlength=n * KINDS)
    counts = counts.reshape(n, KINDS).astype(np.int32)
    block, x, y = [table.column(c).to_numpy() for c in ("block", "x", "y")]
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    apart = np.zeros((len(left), len(right)), np.int32)
    for kind in np.flatnonzero(counts.any(axis=0)):
        apart += np.abs(counts[left, kind][:, None] - counts[right, kind][None, :])
    most = (1.0 - threshold + 1e-12) * (own.sizes[left][:, None] + own.sizes[right][None, :])
    near = apart <= most
    if x[0] == y[0]:
        near &= np.tri(n, k=-1, dtype=bool)
    if gap is not None:
        first, last = [table.column(c).to_numpy().astype(float) for c in ("first", "last")]
        timeless = np.isnan(first)
        close = (first[right][None, :] - last[left][:, None] <= gap) & (first[left][:, None] - last[right][None, :] <= gap)
        near &= close | timeless[left][:, None] | timeless[right][None, :]
    a, b = np.nonzero(near)
    order = np.argsort(apart[a, b], kind="stable")
    return left[a[order]], right[b[order]]


def _spanning(texts: list[str], a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Matches among the pairs that connect what all matches among them connect.

    Of each component the nearest pairs are compared, more of them each time, and pairs within
    one component no more.
    """
    component, width, found = np.arange(len(texts)), 1, [np.zeros((2, 0), np.int64)]
    while True:
        apart = component[a] != component[b]
        a, b = a[apart], b[apart]
        if not len(a):
            pairs = np.concatenate(found, axis=1)
            return pairs[0], pairs[1]
        order = np.argsort(component[a], kind="stable")
        sorted_by = component[a][order]
        rank = np.arange(len(a)) - np.searchsorted(sorted_by, sorted_by)
        chosen = order[rank < width]
        right = chosen[_alike(texts, a[chosen], b[chosen], threshold)]
        found.append(np.stack([a[right], b[right]]))
        component = least_reachable(
            np.concatenate([np.arange(len(texts)), a[right]]), np.concatenate([component, b[right]]), len(texts)
        )
        kept = np.ones(len(a), bool)
        kept[chosen] = False
        a, b, width = a[kept], b[kept], 2 * width


def letter_matches(items: DataFrame, threshold: float, gap: int | None = None) -> DataFrame:
    """Pairs (a, b) of items of one scope whose words' characters alone make them score ``threshold``.

    ``items`` has scope, item, text (the joined words) and length; every match of that kind is
    found. With ``gap`` they also have first and last, only pairs that close in time count (no time
    is close to all), and of those only as many are returned as connect what all connect.

    Items are ordered by length in their scope and cut into blocks. Two blocks meet in a task if
    lengths in them allow a match; their texts go with them, and only matches leave the task.
    """
    timed = [] if gap is None else ["first", "last"]
    placed = position(items.select("scope", "item", "text", "length", *timed), ["scope"], [F.col("length"), F.col("item")], "place")
    blocks = materialize(placed.withColumn("block", F.floor((F.col("place") - 1) / BLOCK)).drop("place"), "blocks")
    ends = blocks.groupBy("scope", "block").agg(F.min("length").alias("least"), F.max("length").alias("most"))
    ratio = (2.0 - threshold) / threshold + 1e-6
    x = ends.select("scope", F.col("block").alias("x"), F.col("most").alias("most_x"))
    y = ends.select("scope", F.col("block").alias("y"), F.col("least").alias("least_y"))
    met = x.join(y, "scope").filter((F.col("x") <= F.col("y")) & (F.col("least_y") <= ratio * F.col("most_x"))).select("scope", "x", "y")
    sides = met.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    dealt = blocks.join(sides, ["scope", "block"])

    def compare(table: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        a, b = _candidates(table, texts, threshold, gap)
        if gap is None:
            right = _alike(texts, a, b, threshold)
            a, b = a[right], b[right]
        else:
            a, b = _spanning(texts, a, b, threshold)
        item = table.column("item").to_numpy()
        return pa.table({"a": item[a], "b": item[b]})

    return dealt.groupBy("scope", "x", "y").applyInArrow(compare, "a long, b long")
