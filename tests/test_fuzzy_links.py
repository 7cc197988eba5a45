import random

from pyspark.sql import functions as F

from resultloom.operators import fuzzy
from resultloom.operators.components import components

DAY = 86400


def linked(spark, monkeypatch, rows, small_scope):
    """(component of each cell as the whole set of links gives it, as the joined links give it, pairs compared)."""
    frame = spark.createDataFrame(rows, "id string, search_id string, source_type string, norm_title string, seconds long")
    frame = frame.withColumn("published_at", F.timestamp_seconds("seconds")).withColumn("node", F.col("id"))
    keyed = fuzzy.with_word_key(fuzzy.admissible(frame))
    cells = fuzzy.spans(keyed)
    asked, plain = [], fuzzy._scored
    monkeypatch.setattr(fuzzy, "_scored", lambda pairs, threshold: (asked.append(pairs.count()), plain(pairs, threshold))[1])
    links = fuzzy.fuzzy_links(keyed, cells, small_scope=small_scope)
    label = lambda found: {r.node: r.component for r in components(found).collect()}
    return keyed, cells, label(links), sum(asked)


def test_links_connect_what_all_matches_connect(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    rows = []
    for family in range(12):
        title = [rng.choice(words) for _ in range(rng.randint(3, 7))]
        for _ in range(9):
            text = list(" ".join(title))
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice("abcxyz")
            seconds = None if rng.random() < 0.1 else rng.randrange(60) * DAY
            rows.append((f"r{len(rows):03d}", f"s{family % 2}", "news", "".join(text), seconds))
    keyed, cells, got, _ = linked(spark, monkeypatch, rows, 0)
    monkeypatch.undo()
    whole = fuzzy.cell_links(cells, fuzzy.title_matches(keyed))
    want = {r.node: r.component for r in components(whole).collect()}
    assert len(set(want.values())) > 5 and got == want
    assert linked(spark, monkeypatch, rows, 64)[2] == want


def test_thousands_of_near_equal_titles_write_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = "storm warning issued for the northern harbour and all ferries delayed until tonight"
    rows = []
    for i in range(1200):
        text = list(base)
        # A number of their own, so that every title is another word set.
        text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((f"r{i:04d}", "s", "news", "".join(text) + f" {i}", rng.randrange(20) * DAY))
    _, cells, got, asked = linked(spark, monkeypatch, rows, 64)
    assert len(got) == cells.count() and len(set(got.values())) == 1
    assert asked < 40 * len(rows)
