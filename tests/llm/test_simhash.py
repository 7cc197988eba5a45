import re

import xxhash

from resultloom.llm.bindings import op4_simhash
from resultloom.llm.simhash import BKTree, fingerprint, linked, near_duplicates, one_of_each

TESTDATA = "/root/testdata/sf0.001"


def brute_print(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, radius=3):
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {v: top(v) for v in root}


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    part = brute_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        least[part[p]] = min(least.get(part[p], i), i)
    return sorted((i, f"{p:016x}", least[part[p]]) for i, p in prints)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_simhash(spark, TESTDATA).collect())) == brute(rows)


def test_links_in_crowded_blocks(spark):
    import random

    rng = random.Random(5)
    values = {0, 2**64 - 1}
    for _ in range(30):
        seed = rng.getrandbits(64)
        for _ in range(12):
            values.add(seed)
            seed ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                seed ^= 1 << rng.randrange(64)
    values |= {0xABCD << 48 | rng.getrandbits(10) << 20 for _ in range(60)}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    for nodes in (4096, 20, 5):
        found = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in linked(df, tree_nodes=nodes).collect()]
        root = {v: v for v in values}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in found:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
        assert {v: top(v) for v in values} == brute_components(values)


def test_tree_follows_edges_in_reach():
    tree = BKTree()
    values = [0, 1, 3, 7, 2**64 - 1, 2**63, 12]
    for v in values:
        tree.add(v)
    for q in (0, 5, 2**64 - 2):
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_odd_rows(spark):
    rows = [(7, None), (5, ""), (9, " \n"), (3, "One"), (4, "one"), (6, "a b"), (8, "x " * 20000), (8, "x " * 20000), (2, "É é")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id int, text string, fp int, component_id string")
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})
    nulls = spark.createDataFrame([(None, "same"), (None, "same"), (1, "same"), (None, "other words here now")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in one_of_each(nulls).collect()) == [("1", "same"), ("None", "other words here now")]
    assert near_duplicates(docs.limit(0)).collect() == []
    assert fingerprint(None) == 0
