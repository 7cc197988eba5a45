"""Word-set similarity of titles, 0..100."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Lanes that are compared at once, and entries of their tables of places, unless 64 lanes have more.
LANES, TABLE = 4096, 1 << 21

# Lanes for each 64-bit word of the texts, under which pairs are compared one by one.
LONG = 10


class Texts:
    """Code points of many texts: ``points`` in a row, text i from ``starts[i]`` on, ``sizes[i]`` of them."""

    def __init__(self, texts: list[str]) -> None:
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def padded(self, rows: np.ndarray, width: int, filler: int) -> np.ndarray:
        """The texts ``rows`` as a matrix, each filled up to ``width``."""
        at = np.arange(width)
        spots = np.minimum(self.starts[rows, None] + at, len(self.points) - 1)
        values = self.points[spots] if len(self.points) else np.zeros(spots.shape, self.points.dtype)
        return np.where(at < self.sizes[rows, None], values, values.dtype.type(filler))


def numbered(a: Texts, b: Texts) -> int:
    """Give the characters of both numbers from 1 on; the count of them, with 0 for none."""
    seen = np.zeros(0x110000, bool)
    seen[a.points] = seen[b.points] = True
    number = np.cumsum(seen, dtype=np.int32)
    a.points, b.points = number[a.points], number[b.points]
    return int(number[-1]) + 1


def common_subsequences(a: Texts, b: Texts, rows: np.ndarray, characters: int) -> np.ndarray:
    """Length of the longest common subsequence of each of the pairs ``rows``, all in step.

    Bit-parallel row updates after Hyyro (2004), in which a zero bit marks a matched place of ``b``. Each pair
    has a lane of 64-bit words, as many as its ``b`` needs, and a table of the places of every
    character in them; a step takes the next character of ``a`` in all lanes, and sums carry from
    word to word.
    """
    words = max(1, -(-int(b.sizes[rows].max(initial=1)) // 64))
    left = np.ascontiguousarray(a.padded(rows, int(a.sizes[rows].max(initial=0)), 0).T)
    right = np.ascontiguousarray(b.padded(rows, int(b.sizes[rows].max(initial=0)), 0).T)
    lane = np.arange(len(rows)) * characters
    places = np.zeros((words, len(rows) * characters), np.uint64)
    for at, ch in enumerate(right):
        places[at // 64, lane + ch] |= np.uint64(1 << at % 64)
    # What fills up the texts matches nothing.
    places[:, lane] = 0
    state = np.full((words, len(rows)), np.uint64(2**64 - 1))
    for ch in left:
        carry = np.uint64(0)
        for w in range(words):
            row = state[w]
            hit = row & places[w, lane + ch]
            total = row + hit
            if words > 1:
                over = total < row
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
            state[w] = total | (row - hit)
    # Places past the end of b never match, so they keep their bits.
    return (64 - np.bitwise_count(state).astype(np.int64)).sum(axis=0)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence of two texts, the places of ``b`` in one whole number."""
    places: dict[str, int] = {}
    for at, ch in enumerate(b):
        places[ch] = places.get(ch, 0) | 1 << at
    every = (1 << len(b)) - 1
    state = every
    for ch in a:
        hit = state & places.get(ch, 0)
        state = ((state + hit) | (state - hit)) & every
    return len(b) - state.bit_count()


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Common subsequence lengths of pairs of texts, compared in lanes of similar size.

    Texts of many words, of which there are few, are compared one by one: their steps would
    cost more than the lanes save.
    """
    # The shorter text has the bits, the longer one the steps.
    turned = [(y, x) if len(x) < len(y) else (x, y) for x, y in zip(a, b)]
    long, short = Texts([x for x, _ in turned]), Texts([y for _, y in turned])
    characters = numbered(long, short)
    found = np.zeros(len(a), np.int64)
    words = -(-short.sizes // 64)
    order = np.lexsort((long.sizes, words))
    for same in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
        lanes = max(64, min(LANES, TABLE // (characters * max(1, int(words[same[:1]].sum())))))
        for low in range(0, len(same), lanes):
            rows = same[low : low + lanes]
            if len(rows) < LONG * words[rows[0]]:
                found[rows] = [common_subsequence(*turned[row]) for row in rows]
            else:
                found[rows] = common_subsequences(long, short, rows, characters)
    return found


@F.pandas_udf(T.IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two texts; null beside a null one."""
    both = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), -1, np.int64)
    if both.any():
        out[both] = common_lengths(a[both].tolist(), b[both].tolist())
    return pd.Series(out, dtype="Int32").mask(out < 0)


# Keeps Spark from evaluating the comparison once for a filter and again for its output.
common_length = common_length.asNondeterministic()


class WordSets:
    """The expressions a pair of sorted distinct word arrays is judged by.

    With I the shared words and D1, D2 the rest of each side, joined by spaces,
    the similarity is 100 when I is not empty and a rest is; else the best of the
    edit ratios of (I D1, I D2), (I, I D1) and (I, I D2), an edit being one
    insertion or deletion. Only the first needs the common subsequence of D1, D2.
    """

    def __init__(self, a: Column, b: Column) -> None:
        self.rest_a = F.array_join(F.array_except(a, b), " ")
        self.rest_b = F.array_join(F.array_except(b, a), " ")
        self.shared = F.length(F.array_join(F.array_intersect(a, b), " "))
        self.some = F.when(self.shared > 0, 1).otherwise(0)
        self.len_a = F.length(self.rest_a)
        self.len_b = F.length(self.rest_b)
        self.total = 2 * (self.shared + self.some) + self.len_a + self.len_b
        self.contained = (self.shared > 0) & ((self.len_a == 0) | (self.len_b == 0))

    @staticmethod
    def _ratio(distance: Column, total: Column) -> Column:
        return 100.0 - 100.0 * distance / total

    def _beside_shared(self, rest: Column) -> Column:
        return F.when(
            self.shared > 0, self._ratio(self.some + rest, 2 * self.shared + self.some + rest)
        ).otherwise(0.0)

    @classmethod
    def reachable(cls, a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
        """The most a pair can score, from the joined lengths of both and of what they share.

        The shared words are found once per pair and their length bound to a name.
        """
        def bound(shared: Column) -> Column:
            some = F.when(shared > 0, 1).otherwise(0)
            rest_a = F.greatest(length_a - shared - some, F.lit(0))
            rest_b = F.greatest(length_b - shared - some, F.lit(0))
            beside = lambda rest: F.when(
                shared > 0, cls._ratio(some + rest, 2 * shared + some + rest)
            ).otherwise(0.0)
            total = 2 * (shared + some) + rest_a + rest_b
            return F.when((shared > 0) & ((rest_a == 0) | (rest_b == 0)), 100.0).otherwise(
                F.greatest(
                    cls._ratio(F.abs(rest_a - rest_b), total), beside(rest_a), beside(rest_b)
                )
            )

        shared = F.length(F.array_join(F.array_intersect(a, b), " "))
        return F.element_at(F.transform(F.array(shared), bound), 1)

    def score(self, common: Column) -> Column:
        """The similarity; without ``common``, what it is apart from the characters of the rests."""
        return F.when(self.contained, 100.0).otherwise(
            F.greatest(
                self._ratio(self.len_a + self.len_b - 2 * common, self.total),
                self._beside_shared(self.len_a),
                self._beside_shared(self.len_b),
            )
        )
