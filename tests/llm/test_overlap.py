import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from resultloom.llm import overlap, simhash
from resultloom.runtime import materialize
from test_simhash import brute_components, brute_print

TESTDATA = "/root/testdata/sf0.001"


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, similarity=(4, 5)):
    """Least ids of the groups linked by 3 bits or by Jaccard similarity, and the similar pairs that 3 bits link."""
    prints = {i: brute_print(t) for i, t in rows}
    part, sets = brute_components(set(prints.values())), {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for a in sets:
        for b in sets:
            if a < b:
                similar = sets[a] and len(sets[a] & sets[b]) * similarity[1] >= len(sets[a] | sets[b]) * similarity[0]
                if similar:
                    pairs.append((prints[a] ^ prints[b]).bit_count() <= 3)
                if similar or part[prints[a]] == part[prints[b]]:
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return sorted(i for i in root if top(i) == i), pairs


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect())


def test_scattered_edits(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    # Families of copies, each from the one before, so that some are similar only by way of others.
    for _ in range(14):
        text = [rng.choice(words) for _ in range(rng.choice([4, 12, 60, 150, 260]))] + passage
        for _ in range(6):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.choice([0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(1000, None), (1001, ""), (1002, "one Two"), (1003, "ONE two"), (1004, "one two three"), (1005, " ".join(passage))]
    # Equality at the bound: 8 shingles, of which 8 in 10 are common.
    run = [f"w{i}" for i in range(14)]
    rows += [(1010, " ".join(run[:12])), (1011, " ".join(run)), (1012, " ".join(run[:9]))]
    want, pairs = brute(rows)
    assert len(pairs) > 40 and pairs.count(False) > 20
    assert kept(spark, rows) == want


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    assert kept(spark, rows) == brute(rows)[0]


def joined(spark, monkeypatch, texts):
    """(groups of positions that the join alone finds, pairs that it looked at)."""
    asked, plain = [], overlap._similar
    monkeypatch.setattr(overlap, "_similar", lambda pairs, *rest: (asked.append(pairs.count()), plain(pairs, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "text_key long, text string")
    sets = materialize(docs.mapInArrow(simhash._sets, "text_key long, set long"), "test")
    start = sets.groupBy("set").agg(F.min("text_key").alias("component"), F.min("text_key").alias("text_key"))
    found = overlap.join_similar(docs, start).join(sets, "set").groupBy("component").agg(F.sort_array(F.collect_list("text_key")).alias("own"))
    return sorted(r.own for r in found.collect()), sum(asked)


def test_one_template_is_not_paired(spark, monkeypatch):
    # All just under the bound, but for two with one word more.
    texts = [f"sorry the page you have asked for is not {i * 7919}" for i in range(2000)]
    texts += ["sorry the page you have asked for is not here any more on our hosts", "sorry the page you have asked for is not here any more on our hosts x"]
    groups, asked = joined(spark, monkeypatch, texts)
    assert groups == [*[[i] for i in range(2000)], [2000, 2001]]
    assert asked < 100


def test_a_family_meets_its_first(spark, monkeypatch):
    rng = random.Random(3)
    text = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for i in range(400):
        own = list(text)
        own[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(own))
    groups, asked = joined(spark, monkeypatch, texts)
    assert groups == [list(range(400))]
    assert asked < 400 * 40


def test_only_doubtful_rows_are_dealt_with_their_texts(spark):
    """Rows that stay go past the shuffle; those that go, and equal rows, do not."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    rows = [(i, text()) for i in range(300)]
    rows += [(400 + i, rows[i][1]) for i in range(20)] + [rows[7], rows[7], (None, "alone here"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.one_of_each(docs)
    assert sorted(found.collect(), key=str) == sorted([*rows[:300], (None, "alone here")], key=str)
    marked = docs.select(F.xxhash64("doc_id", "text").alias("text_key"), F.col("doc_id").alias("id"))
    asked = marked.filter("id between 400 and 409")
    told = {r.id for r in marked.filter(overlap.is_marked(asked, F.col("text_key"))).collect()}
    assert told >= set(range(400, 410)) and len(told) < 15


def test_counters_of_a_task_are_told_as_bits_where_many_are_held():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    told = lambda n: [b for b in overlap._count(12)(iter([pa.record_batch([pa.array([" ".join(str(rng.randrange(40)) for _ in range(n))])], names=["text"])]))]
    few, many = told(30), told(3000)
    assert all(not b.column("held")[0].as_py() for b in few) and all(len(b.column("held")[0].as_py()) == 32 for b in many)
    for batches in (few, many, few + many):
        for number in range(overlap.SLICES):
            own = [b for b in batches if b.column("slice")[0].as_py() == number]
            if own:
                got = np.frombuffer(overlap._levels(12)(pa.Table.from_batches(own)).column("levels")[0].as_py(), np.uint8)
                want = np.zeros(256, int)
                for b in own:
                    held = np.frombuffer(b.column("held")[0].as_py(), np.uint8)
                    at, counts = np.frombuffer(b.column("at")[0].as_py(), np.uint32), np.frombuffer(b.column("counts")[0].as_py(), np.uint8)
                    part = np.unpackbits(held).astype(int) if len(held) else np.zeros(256, int)
                    part[at] = counts
                    want += part
                assert (got == np.ceil(np.log2(want + 1))).all()
