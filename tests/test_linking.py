import random
import re

import pytest
from pyspark.sql import functions as F

from resultloom.operators import fuzzy
from resultloom.operators.components import components
from resultloom.operators.dedup import all_groups, annotate, exact_groups, fuzzy_groups
from test_functions import table_lcs

WEEK = 7 * 86400


def similarity(a, b):
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    one, two = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not one or not two):
        return 100.0
    gap = 1 if shared else 0
    total = 2 * (len(shared) + gap) + len(one) + len(two)
    best = 100 - 100 * (len(one) + len(two) - 2 * table_lcs(one, two)) / total
    if shared:
        for rest in (one, two):
            best = max(best, 100 - 100 * (1 + len(rest)) / (2 * len(shared) + 1 + len(rest)))
    return best


@pytest.mark.parametrize("threshold", [0.9, 0.8])
def test_title_matches_are_complete(spark, threshold):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(50)]
    titles = set()
    while len(titles) < 160:
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 8)))
        for edits in (0, 1, 2, 4):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = rng.choice("abcxyz ")
            words = "".join(text).split()
            rng.shuffle(words)
            if len(words) >= 3:
                titles.add(" ".join(words))
    rows = spark.createDataFrame([("s", "news", t) for t in titles], "search_id string, source_type string, norm_title string")
    rows = fuzzy.with_word_key(fuzzy.admissible(rows))
    names = {r.word_key: " ".join(r.words) for r in rows.collect()}
    sets = sorted(set(names.values()))
    want = {(a, b): similarity(a, b) for i, a in enumerate(sets) for b in sets[i + 1:]}
    want = {k: v for k, v in want.items() if v >= threshold * 100}
    assert want
    for small in (0, 10**6):
        found = fuzzy.title_matches(rows, threshold, small_scope=small).collect()
        got = {tuple(sorted((names[r.key_a], names[r.key_b]))): r.score for r in found}
        assert got == pytest.approx(want)


def corpus(rng, n=90):
    words = "rain coast storm warning issued for north harbour ferry delayed again tonight".split()
    rows = []
    for i in range(n):
        title = " ".join(rng.sample(words, rng.randint(1, 7)))
        if i % 3 == 0 and rows:
            title = rng.choice(rows)[4] + rng.choice(["", " now", " - CNN"])
        if i % 5 == 0 and rows:
            text = list(rng.choice(rows)[4])
            text[rng.randrange(len(text))] = "z"
            title = "".join(text)
        at = None if rng.random() < 0.2 else 1_700_000_000 + rng.randrange(30 * 86400)
        kind = rng.choice(["news", "news", "social", "reference"])
        rows.append((f"s{i % 2}", f"r{i:03d}", kind, "X", title, None, f"https://e.test/{rng.randrange(n * 3)}", at))
    return rows


def brute(rows):
    def norm(title):
        title = re.sub(r"(\s*-\s*cnn)+$", "", title.strip().lower())
        return re.sub(r"\s+", " ", title).strip()

    titles = [norm(r[4]) for r in rows]
    pairs = {"canonical_url": set(), "normalized_title": set(), "fuzzy_title": set()}
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if a[0] != b[0]:
                continue
            if a[6] == b[6]:
                pairs["canonical_url"].add((i, j))
            if a[2] != b[2]:
                continue
            if titles[i] == titles[j] != "":
                pairs["normalized_title"].add((i, j))
            close = a[7] is None or b[7] is None or abs(a[7] - b[7]) <= WEEK
            long = min(len(titles[i].split()), len(titles[j].split())) >= 3
            if a[2] != "reference" and close and long and similarity(titles[i], titles[j]) >= 90:
                pairs["fuzzy_title"].add((i, j))
    return pairs


def closed(rows, pairs, kinds):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for kind in kinds:
        for a, b in pairs[kind]:
            parent[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return {
        tuple(sorted(rows[i][1] for i in g)): [
            k for k in sorted(kinds) if any((x, y) in pairs[k] for x in g for y in g)
        ]
        for g in groups.values()
        if len(g) > 1
    }


def found(members, groups):
    out = {}
    for r in members.join(groups.select("component", "methods"), "component").collect():
        out.setdefault(r.component, ([], r.methods))[0].append(r.id)
    return {tuple(sorted(ids)): methods for ids, methods in out.values()}


@pytest.fixture(scope="module")
def linked(spark):
    rows = corpus(random.Random(3))
    schema = "search_id string, id string, source_type string, source_name string, title string, description string, url string, at long"
    df = spark.createDataFrame(rows, schema).withColumn("published_at", F.timestamp_seconds("at")).drop("at")
    return rows, brute(rows), df


def test_groups_match_brute_force(linked):
    rows, pairs, df = linked
    assert all(pairs.values())
    assert found(*exact_groups(df)) == closed(rows, pairs, ["canonical_url", "normalized_title"])
    assert found(*fuzzy_groups(df)) == closed(rows, pairs, ["fuzzy_title"])
    assert found(*all_groups(df)) == closed(rows, pairs, list(pairs))


def test_annotation_keeps_rows_and_one_canonical(linked):
    rows, pairs, df = linked
    annotated, groups = annotate(df)
    got = annotated.collect()
    assert sorted(r.id for r in got) == sorted(r[1] for r in rows)
    sizes = {g.group_id: (g.member_count, g.canonical_id) for g in groups.collect()}
    for group, (n, canonical) in sizes.items():
        members = [r for r in got if r.duplicate_group_id == group]
        assert len(members) == n
        assert [m.id for m in members if not m.is_duplicate] == [canonical]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    hub = [("h000", f"h{i:03d}") for i in range(1, 60)]
    edges = spark.createDataFrame(chain[::-1] + hub, "a string, b string")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{f"c{i:03d}": "c000" for i in range(41)}, **{f"h{i:03d}": "h000" for i in range(60)}}
