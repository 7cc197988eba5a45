import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from resultloom.operators import admission, ranking, statistics, views
from resultloom.operators.skew import running_total
from resultloom.plans import evaluation

NOW = "2024-01-31 00:00:00"
NOW_S = 1706659200
PRIORITY = {"news": 0, "social": 1, "reference": 2}
WEIGHTS = {"news": (0.55, 0.30, 0.15), "social": (0.55, 0.30, 0.15), "reference": (0.65, 0.10, 0.25)}


def sample(n=160):
    rng = random.Random(7)
    words = "storm coast ferry rain".split() + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(n):
        rows.append((
            "hot" if i % 3 else f"s{i % 4}", f"r{i:03d}", rng.choice(list(PRIORITY)),
            rng.choice(["The Guardian", "Other"]), " ".join(rng.sample(words, 4)), " ".join(rng.sample(words, 6)),
            f"https://e.test/{rng.randrange(50)}", None if i % 9 == 0 else NOW_S - rng.randrange(90) * 3600,
        ))
    groups = {}
    for i in range(0, n - 12, 12):
        if rows[i][0] == rows[i + 12][0]:
            groups[rows[i][1]] = (f"g{i}", False)
            groups.setdefault(rows[i + 12][1], (f"g{i}", True))
    return [(*r, *groups.get(r[1], (None, False))) for r in rows]


def expected(rows, query):
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    asked = words(query)
    raw = {r[1]: 3 * len(asked & words(r[4])) + len(asked & words(r[5])) for r in rows}
    top = max(raw.values())
    first = {}
    for r in sorted(rows, key=lambda r: r[1]):
        if r[8] and not r[9]:
            first.setdefault(r[8], r)
    scored = []
    for r in rows:
        e = first.get(r[8], r) if r[8] else r
        fresh = 0.5 if e[2] == "reference" else 0.25 if e[7] is None else 0.05 + 0.95 * 2 ** (
            -(NOW_S - e[7]) / 3600 / (24.0 if e[2] == "news" else 12.0))
        quality = 0.9 if e[3] == "The Guardian" else 0.8 if e[2] == "reference" else 0.5
        a, b, c = WEIGHTS[e[2]]
        score = a * (raw[e[1]] / top if top else 0.0) + b * fresh + c * quality
        scored.append((score, r))
    newest = lambda r: (r[7] is None, -(r[7] or 0), r[6], r[1])
    # Bands by their greatest scores, turns by place within band and type: then one sort.
    anchors = []
    for score in sorted({score for score, _ in scored}, reverse=True):
        if not anchors or anchors[-1] - score > 0.05:
            anchors.append(score)
    band = {r[1]: sum(score <= anchor for anchor in anchors) for score, r in scored}
    same_kind = lambda r: [q for _, q in scored if (band[q[1]], q[2]) == (band[r[1]], r[2])]
    turn = {r[1]: sum(newest(q) < newest(r) for q in same_kind(r)) for _, r in scored}
    order = sorted((band[r[1]], turn[r[1]], PRIORITY[r[2]], r[1]) for _, r in scored)
    order = [rid for *_, rid in order]
    return {rid: place for place, rid in enumerate(order)}


@pytest.mark.parametrize("task_rows", [10, 0])
def test_null_keys_stay_in_either_path(spark, task_rows):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, v int")
    out = running_total(rows, ["k"], [F.col("v")], "n", task_rows=task_rows).collect()
    assert sorted((str(r.k), r.v, r.n) for r in out) == [("None", 1, 1), ("None", 2, 2), ("a", 5, 1)]
    middle = statistics.median(rows, ["k"], "v", "m", task_rows=task_rows).collect()
    assert sorted((str(r.k), r.m) for r in middle) == [("None", 1.5), ("a", 5.0)]
    one = statistics.spearman(spark.createDataFrame([(None, i, i * i) for i in range(5)], "k string, x int, y int"), ["k"], "x", "y", task_rows=task_rows).collect()
    assert [(r.k, r.n, round(r.rho, 9)) for r in one] == [(None, 5, 1.0)]


@pytest.mark.parametrize("task_rows", [10**6, 0])
def test_rank_matches_a_plain_loop(spark, task_rows):
    """Both with groups that fit a task and with every group cut into slices."""
    rows = sample()
    schema = ("search_id string, id string, source_type string, source_name string, title string, description string,"
              " url string, at long, duplicate_group_id string, is_duplicate boolean")
    df = spark.createDataFrame(rows, schema).withColumn("published_at", F.timestamp_seconds("at")).drop("at")
    searches = spark.createDataFrame([(s, "Storm ferry, w3") for s in ("hot", "s0", "s1", "s2", "s3")], "search_id string, query string")
    got = {(r.search_id, r.id): r.rank_position for r in ranking.rank_results(df, searches, NOW, task_rows=task_rows).collect()}
    want = {}
    for search in {r[0] for r in rows}:
        places = expected([r for r in rows if r[0] == search], "Storm ferry, w3")
        want.update({(search, rid): p for rid, p in places.items()})
    assert got == want


def test_bands_are_anchored_at_their_first_score(spark):
    scores = [0.97, 0.95, 0.93, 0.92, 0.91, 0.80, 0.76, 0.74]
    df = spark.createDataFrame([("s", str(i), s) for i, s in enumerate(scores)], "search_id string, id string, rank_score double")
    for task_rows in (100, 0):
        rows = ranking.with_bands(df, task_rows=task_rows).orderBy(F.desc("rank_score")).collect()
        assert [r.band for r in rows] == [0, 0, 0, 0, 1, 2, 2, 3]


def test_sliced_running_total_equals_window(spark):
    rows = [("a" if i % 4 else "b", (i * 37) % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    order = [F.col("v").desc(), F.col("i")]
    for weight in (None, F.col("v").cast("long")):
        one = running_total(df, ["k"], order, "t", weight=weight, task_rows=1000)
        many = running_total(df, ["k"], order, "t", weight=weight, task_rows=10)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_statistics_match_pandas(spark):
    rng = random.Random(2)
    pdf = pd.DataFrame({"k": ["a", "b"] * 40, "x": [rng.randrange(9) / 3 for _ in range(80)], "y": [rng.randrange(3) for _ in range(80)]})
    df = spark.createDataFrame(pdf)
    for kw in ({}, {"task_rows": 2}):
        med = {r.k: r.m for r in statistics.median(df, ["k"], "x", "m", **kw).collect()}
        assert med == pytest.approx(pdf.groupby("k").x.median().to_dict())
        rho = {r.k: r.rho for r in statistics.spearman(df, ["k"], "x", "y", **kw).collect()}
        for k, g in pdf.groupby("k"):
            assert rho[k] == pytest.approx(g.x.rank().corr(g.y.rank()))
    flat = spark.createDataFrame([("a", 1.0, i) for i in range(5)], "k string, x double, y int")
    assert math.isnan(statistics.spearman(flat, ["k"], "x", "y").first().rho)


def test_admission_counts_only_admitted(spark):
    rng = random.Random(4)
    hits = sorted((rng.choice("ab"), rng.randrange(4000), i) for i in range(300))
    df = spark.createDataFrame(hits, "key string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.admitted for r in admission.admit(df.select("key", "ts", "id"), 3, 60.0).collect()}
    want, live = {}, {"a": [], "b": []}
    for key, s, i in sorted(hits, key=lambda h: (h[0], h[1], h[2])):
        live[key] = [x for x in live[key] if x > s - 60]
        want[i] = len(live[key]) < 3
        if want[i]:
            live[key].append(s)
    assert got == want and not all(want.values())


def test_bad_parameters_are_errors():
    for bad in ({"source_types": ["blog"]}, {"time": "1y"}, {"duplicates": "none"}, {"language": "EN"}):
        with pytest.raises(ValueError):
            views.check_filters(**bad)
    for page, per_page in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            views.check_page(page, per_page)


def test_metrics_divide_by_k_and_use_all_labels(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "search_id string, id string, position int")
    grades = spark.createDataFrame([("q", "b", 2), ("q", "c", 1)], "search_id string, id string, rel int")
    row = evaluation.ranking_metrics(ranked, grades).first()
    assert (row.precision_at_5, row.precision_at_10, row.reciprocal_rank) == (0.2, 0.1, 0.5)
    assert row.ndcg_at_10 == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))


def test_pair_counts_match_listed_pairs(spark):
    rng = random.Random(9)
    rows = [("q", f"r{i}", *[rng.choice(["x", "y", "z", None]) for _ in range(3)]) for i in range(30)]
    unclear = [("r1", "r2"), ("r2", "r1"), ("r5", "r9"), ("r3", "r4")]
    labels = spark.createDataFrame(rows, "search_id string, id string, gold string, exact string, near string")
    pairs = spark.createDataFrame(unclear, "a string, b string")
    got = evaluation.dedup_counts(labels, ["exact", "near"], pairs).first()
    skip = {frozenset(p) for p in unclear}
    gold, predicted = set(), set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            pair = frozenset((a[1], b[1]))
            if pair in skip:
                continue
            same = [x is not None and x == y for x, y in zip(a[2:], b[2:])]
            if same[0]:
                gold.add(pair)
            if same[1] or same[2]:
                predicted.add(pair)
    assert (got.gold_pairs, got.predicted_pairs, got.shared_pairs) == (len(gold), len(predicted), len(gold & predicted))
