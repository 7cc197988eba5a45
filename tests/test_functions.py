import pytest
from pyspark.sql import functions as F

from resultloom.functions.scoring import Decay, freshness, instant
from resultloom.functions.similarity import common_lengths
from resultloom.functions.text import clean_queries, with_norm_title
from resultloom.functions.urls import article_url, bare_url, canonical_url, post_url

URLS = {
    "HTTP://Shop.Test:80/Item//9/": "http://shop.test/Item/9",
    "https://me:pw@shop.test:443": "https://shop.test/",
    "https://shop.test:8443/a?z=1&y=2#part": "https://shop.test:8443/a?y=2&z=1",
    "https://shop.test/a?UTM_Source=n&gclid=3&q=": "https://shop.test/a",
    "https://shop.test/a?q=caf%C3%A9+au&p=%zz": "https://shop.test/a?p=%25zz&q=caf%C3%A9+au",
    "https://m.youtube.com/watch?list=7&v=Q1": "https://m.youtube.com/watch?v=Q1",
    "https://theguardian.com/world?page=4&id=2": "https://theguardian.com/world?id=2",
    "MAILTO:Desk@Shop.Test#x": "mailto:desk@shop.test",
    "  https://shop.test/~u/*  ": "https://shop.test/~u/*",
}

TITLES = {
    "  Rain   over the  Coast ": "rain over the coast",
    "Rain over the coast – Reuters": "rain over the coast",
    "Rain | BBC - CNN": "rain",
    "Ｒａｉｎ ｗａｒｎｉｎｇ": "rain warning",
    "Élan, vital! (part_2)": "élan vital part_2",
    "Reuters": "reuters",
    "Rain - our desk": "rain our desk",
    "!!!": "",
}


def test_canonical_url(spark):
    rows = spark.createDataFrame(list(URLS.items()), "url string, want string")
    bad = rows.withColumn("got", canonical_url(F.col("url"))).filter("got <> want").collect()
    assert bad == []
    again = rows.withColumn("got", canonical_url(F.col("want"))).filter("got <> want").collect()
    assert again == []


def test_norm_title(spark):
    rows = spark.createDataFrame(list(TITLES.items()), "title string, want string")
    assert with_norm_title(rows).filter("norm_title <> want").collect() == []


def test_url_builders(spark):
    row = spark.range(1).select(
        article_url(F.lit("A b/ü"), "de").alias("article"),
        post_url(F.lit("/r/x/1/"), F.lit("x"), F.lit("1"), F.lit("https://o.test")).alias("linked"),
        post_url(F.lit(None).cast("string"), F.lit("x"), F.lit("1"), F.lit(None).cast("string")).alias("built"),
        post_url(F.lit(""), F.lit(""), F.lit("1"), F.lit("https://o.test/")).alias("none"),
        bare_url(F.lit("https://o.test/p?q#f")).alias("bare"),
        bare_url(F.lit("ftp://o.test/p")).alias("other"),
    ).first()
    assert row.article == "https://de.wikipedia.org/wiki/A_b%2F%C3%BC"
    assert row.linked == "https://www.reddit.com/r/x/1/"
    assert row.built == "https://www.reddit.com/r/x/comments/1/"
    assert row.none is None and row.bare == "https://o.test/p" and row.other is None


def test_clean_queries(spark):
    rows = spark.createDataFrame(
        [("  Two  Words ", 0), ("", 1), ("x" * 201, 1), ("ok", 9000), ("fine", None)],
        "query string, window_hours int",
    )
    got = {(r.query, r.normalized_query, r.window_hours) for r in clean_queries(rows).collect()}
    assert got == {("Two  Words", "two words", None), ("fine", "fine", None)}


def test_freshness_levels(spark):
    rows = spark.createDataFrame(
        [("news", "2024-01-30 00:00:00"), ("social", "2024-01-30 12:00:00"), ("news", None),
         ("reference", None), ("news", "2024-02-09 00:00:00")],
        "kind string, at string",
    ).withColumn("pub", F.to_timestamp("at"))
    got = [r.f for r in rows.select(freshness(F.col("pub"), F.col("kind"), instant("2024-01-31 00:00:00")).alias("f")).collect()]
    assert got == pytest.approx([0.525, 0.525, 0.25, 0.5, 1.0])
    with pytest.raises(Exception, match="not defined"):
        spark.range(1).select(freshness(F.lit(None).cast("timestamp"), F.lit("video"), instant("2024-01-31"))).collect()
    with pytest.raises(ValueError):
        Decay(shape="square")


def table_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(line[j] + 1 if x == y else max(line[j + 1], new[-1]))
        line = new
    return line[-1]


def test_common_subsequences_in_lanes():
    import random

    rng = random.Random(5)
    pairs = []
    for size in (0, 1, 16, 63, 64, 65, 128, 130, 300):
        for other in (0, 1, 30, 64, 65, 129):
            letters = rng.choice(["ab", "abcé ", "abcdefgh 𝄞日本"])
            pairs += [tuple("".join(rng.choice(letters) for _ in range(n)) for n in (size, other)) for _ in range(3)]
    # More characters than a table has room for at once.
    pairs.append(("".join(chr(0x4E00 + i) for i in range(3000)), "".join(chr(0x4E00 + i) for i in range(0, 3000, 7))))
    want = [len(b) if len(a) == 3000 else table_lcs(a, b) for a, b in pairs]
    assert common_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    assert common_lengths([], []).tolist() == []
