import re

import numpy as np

from resultloom.llm.bindings import op2_decontamination
from resultloom.llm.tiling import contamination, decontaminate, tiles

TESTDATA = "/root/testdata/sf0.001"


def greedy(a, b, least):
    """Greedy string tiling from the definition."""
    free_a, free_b, laid = [True] * len(a), [True] * len(b), []
    while True:
        best = least
        found = []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return laid
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                laid.append((i, j, best))


def test_tiles_cover_as_the_definition():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, 25).astype(np.uint64), rng.integers(0, 4, 40).astype(np.uint64)
        got, want = tiles(a, b, 3), greedy(a.tolist(), b.tolist(), 3)
        assert sorted(n for _, _, n in got)[-1:] == sorted(n for _, _, n in want)[-1:]
        for cover, size in ((0, len(a)), (1, len(b))):
            marks = np.zeros(size, int)
            for t in got:
                marks[t[cover] : t[cover] + t[2]] += 1
            assert marks.max(initial=0) <= 1
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in got)
        # Nothing of the least length is left unmarked in both.
        free = [np.ones(len(a), bool), np.ones(len(b), bool)]
        for i, j, n in got:
            free[0][i : i + n] = free[1][j : j + n] = False
        left = [{tuple(x[k : k + 3]) for k in range(len(x) - 2) if f[k : k + 3].all()} for x, f in zip((a, b), free)]
        assert not left[0] & left[1]


def test_query_finds_the_planted_items(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]

    def norm(t):
        return " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "

    held = {d: sorted(i for i, x in items if norm(x) in norm(t)) for d, t in docs}
    got = {r.doc_id: list(r["items"]) for r in op2_decontamination(spark, TESTDATA).collect()}
    assert got == held and any(held.values())


def test_reordered_and_odd_rows(spark):
    parts = ["the river rose in march", "nobody had seen the old bridge", "it fell before the bells rang out", "and two boats were lost that night"]
    item = ". ".join(parts) + "."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Rare phrase"), (1, item), (None, "null id but eight words are in here")], "item_id long, text string")
    rows = [(1, "Start. " + "! ".join(reversed(parts)).upper() + " end"), (2, parts[0] + " and more"), (3, None), (4, ""), (5, "x " * 20000 + item), (6, "a RARE  phrase."),
            (7, " ".join(w for p in parts for w in reversed(p.split()))), (8, "null id but eight words are in here"), (9, "clean words"), (9, "clean words"), (9, item), (None, item)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, text_key string, item_id int")
    for options in ({}, {"block_bytes": 40}):
        got = sorted((str(r.doc_id), r.contaminated, list(r["items"])) for r in contamination(docs, items, **options).collect())
        assert got == sorted([("1", True, [1]), ("2", False, []), ("3", False, []), ("4", False, []), ("5", True, [1]), ("6", True, [4]), ("7", False, []),
                              ("8", True, []), ("9", False, []), ("9", False, []), ("9", True, [1]), ("None", True, [1])])
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7, 9, 9]
    assert contamination(docs.limit(0), items).collect() == [] and decontaminate(docs, items.limit(0)).count() == len(rows)
