import random

import numpy as np

from resultloom.functions import similarity
from resultloom.operators import fuzzy, letters


def titles_of(spark, texts, search="s"):
    rows = [(f"r{i:04d}", search, "news", text) for i, text in enumerate(texts)]
    return fuzzy.with_word_key(fuzzy.admissible(spark.createDataFrame(rows, "id string, search_id string, source_type string, norm_title string")))


def typos(rng, families, copies):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    for _ in range(families):
        title = " ".join(rng.sample(words, rng.randint(4, 9)))
        for _ in range(copies):
            text = list(title)
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice("abcxyz")
            yield "".join(text)


def test_blocks_find_the_matches_that_direct_comparison_finds(spark, monkeypatch):
    rows = titles_of(spark, typos(random.Random(3), 12, 6))
    pairs = lambda small: {tuple(r) for r in fuzzy.title_matches(rows, small_scope=small).collect()}
    direct = pairs(1000)
    monkeypatch.setattr(letters, "BLOCK", 7)
    assert len(direct) > 50 and pairs(0) == direct


def test_a_long_title_is_found_under_its_words_and_not_under_its_letters(spark):
    rng = random.Random(5)
    long = [" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(200)) for _ in range(3)]
    rows = titles_of(spark, long)
    _, many = fuzzy._titles(rows, fuzzy.THRESHOLD, 0)
    _, index = fuzzy._probes_and_index(many, fuzzy.THRESHOLD)
    assert index.count() == 600


def test_few_pairs_of_a_block_are_compared_where_all_are_near(monkeypatch):
    base = "storm warning issued for the northern harbour and all ferries delayed until tonight"
    texts = [" ".join(sorted(set(f"{base} {i}".split()))) for i in range(300)]
    asked, plain = [], letters.common_lengths
    monkeypatch.setattr(letters, "common_lengths", lambda a, b: (asked.append(len(a)), plain(a, b))[1])
    n = len(texts)
    a, b = np.nonzero(np.tri(n, k=-1, dtype=bool))
    left, right = letters._spanning(texts, a, b, 0.9)
    assert len(set(left) | set(right)) == n and sum(asked) < 4 * n


def test_one_by_one_comparison_is_that_of_lanes(monkeypatch):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abc é日😀") for _ in range(rng.choice([0, 1, 63, 64, 65, 400])))
    a, b = [text() for _ in range(40)], [text() for _ in range(40)]
    alone = [similarity.common_subsequence(x, y) for x, y in zip(a, b)]
    monkeypatch.setattr(similarity, "LONG", 0)
    assert similarity.common_lengths(a, b).tolist() == alone
