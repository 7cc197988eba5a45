"""Term-weighted relevance inside each search, measured but not used for serving."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultloom.functions.scoring import WIDE_TYPE_ORDER, type_order
from resultloom.functions.text import content_tokens, shorten, strip
from resultloom.operators.ranking import KEYS, baseline_positions
from resultloom.operators.skew import largest_group, lookup, position
from resultloom.plans.evaluation import METRICS, macro_means, ranking_metrics, with_grades
from resultloom.runtime import materialize

# Term saturation.
K1 = 1.5

Idf = Callable[[Column, Column], Column]

# Inverse document frequency of a term in n of N documents.
IDF: dict[str, Idf] = {
    "smooth1": lambda total, n: F.log(1 + (total - n + 0.5) / (n + 0.5)),
    "smooth2": lambda total, n: F.log(1 + (total - n) / (n + 1)),
    "classic": lambda total, n: F.when(
        total - n + 0.5 > 0, F.greatest(F.lit(0.0), F.log((total - n + 0.5) / (n + 0.5)))
    ).otherwise(0.0),
}


@dataclass(frozen=True)
class Variant:
    title: float = 2.0
    description: float = 1.0
    b: float = 0.75
    idf: str = "smooth1"


# The variants compared.
VARIANTS = {
    "core": Variant(),
    "title_only": Variant(title=1.0, description=0.0),
    "idf_classic": Variant(idf="classic"),
    "idf_smooth2": Variant(idf="smooth2"),
    "b_0.0": Variant(b=0.0),
    "b_0.5": Variant(b=0.5),
    "b_1.0": Variant(b=1.0),
    "description_0.5": Variant(description=0.5),
    "description_2.0": Variant(description=2.0),
}


def collection_statistics(results: DataFrame) -> DataFrame:
    """Documents holding each term of each field of each search."""
    fields = F.array(
        F.struct(F.lit("title").alias("field"), F.array_distinct(content_tokens(F.col("title"))).alias("terms")),
        F.struct(
            F.lit("description").alias("field"),
            F.array_distinct(content_tokens(F.col("description"))).alias("terms"),
        ),
    )
    return (
        results.select("search_id", F.explode(fields).alias("f"))
        .select("search_id", "f.field", F.explode("f.terms").alias("term"))
        .groupBy("search_id", "field", "term")
        .agg(F.count("*").alias("documents"))
    )


def field_lengths(results: DataFrame) -> DataFrame:
    """Documents and mean term counts of each search."""
    return results.groupBy(*KEYS).agg(
        F.count("*").alias("documents"),
        F.avg(F.size(content_tokens(F.col("title")))).alias("title_terms"),
        F.avg(F.size(content_tokens(F.col("description")))).alias("description_terms"),
    )


def asked_terms(searches: DataFrame) -> DataFrame:
    """The distinct terms of each query in order, and the places of each in it."""
    words = content_tokens(F.col("query"))
    return searches.select("search_id", F.col("query").alias("_query"), words.alias("_words"), F.array_distinct(words).alias("terms")).select(
        "search_id", "_query", "terms",
        F.transform("terms", lambda t: F.filter(F.transform("_words", lambda w, at: F.when(w == t, at)), lambda at: at.isNotNull())).alias("places"),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def measured(results: DataFrame, searches: DataFrame) -> DataFrame:
    """Rows without their descriptions, with all that BM25 needs of their texts, written once.

    ``t_length`` and ``d_length`` are the terms in title and description, ``t_tf`` and ``d_tf`` how often
    each distinct term of the query occurs in them, in the order of the query, and the bonuses are columns
    of their names. This is the one place that reads the texts.
    """
    rows = lookup(results, asked_terms(searches).select("search_id", "_query", "terms"), KEYS, how="left")

    def counted(column: str) -> Column:
        times = lambda words: F.transform("terms", lambda t: F.size(F.filter(words, lambda w: w == t)))
        return _let(content_tokens(F.col(column)), lambda words: F.struct(F.size(words).alias("length"), times(words).alias("tf")))

    told = rows.withColumn("_t", counted("title")).withColumn("_d", counted("description"))
    given = bonuses(F.col("_query"), F.col("title"), F.col("description"))
    return materialize(
        told.select(
            *[c for c in results.columns if c != "description"],
            F.col("_t.length").alias("t_length"), F.col("_d.length").alias("d_length"),
            F.col("_t.tf").alias("t_tf"), F.col("_d.tf").alias("d_tf"), *[c.alias(n) for n, c in given.items()],
        ),
        "measured",
    )


def search_statistics(narrow: DataFrame, searches: DataFrame) -> DataFrame:
    """Per search: its terms and their places, rows, mean lengths, and how many rows hold each term.

    ``t_n`` and ``d_n`` are in the order of the terms. Rows are added up per task before the shuffle,
    and a search is one row whose arrays are as long as its query.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_tf").alias("tf")) for f in ("t", "d")])
    holders = (
        narrow.select("search_id", F.explode(fields).alias("f"))
        .select("search_id", "f.field", F.posexplode("f.tf").alias("at", "tf"))
        .filter("tf > 0")
        .groupBy("search_id", "field", "at").agg(F.count("*").alias("n"))
        .groupBy("search_id").agg(*[
            F.map_from_entries(F.collect_list(F.when(F.col("field") == f, F.struct("at", "n")))).alias(f"_{f}") for f in ("t", "d")
        ])
    )
    lengths = narrow.groupBy(*KEYS).agg(
        F.count("*").alias("documents"), F.avg("t_length").alias("title_terms"), F.avg("d_length").alias("description_terms")
    )
    stats = asked_terms(searches).drop("_query").join(lengths, "search_id").join(holders, "search_id", "left")
    n = lambda f: F.transform("terms", lambda t, at: F.coalesce(F.try_element_at(F.col(f"_{f}"), at), F.lit(0)))
    return stats.withColumn("t_n", n("t")).withColumn("d_n", n("d")).drop("_t", "_d")


def offered(variants: dict[str, Variant] | DataFrame) -> Column:
    """The variants as one array of structs (variant, title, description, b, idf).

    A DataFrame of those columns is gathered by a subquery into one value, so the plan is the same for any number
    of its rows.
    """
    if isinstance(variants, DataFrame):
        kinds = {"variant": "string", "title": "double", "description": "double", "b": "double", "idf": "string"}
        row = F.struct(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
        return variants.agg(F.sort_array(F.collect_list(row))).scalar()
    rows = [
        F.struct(F.lit(n).alias("variant"), *[F.lit(getattr(v, c)).alias(c) for c in ("title", "description", "b", "idf")])
        for n, v in variants.items()
    ]
    return F.array(*rows)


def _score(tf: dict[str, Column], lengths: dict[str, Column], variant: Column, kinds: dict[str, Idf]) -> Column:
    """Weighted sums over the places of the query, in its order, for one variant.

    Reads the columns of ``search_statistics``.
    """
    def idf(n: Column) -> Column:
        chain = F
        for name, formula in kinds.items():
            chain = chain.when(variant["idf"] == name, formula(F.col("documents"), n))
        return chain.otherwise(F.raise_error(F.concat(F.lit("unknown idf "), variant["idf"])).cast("double"))

    def field(f: str, mean: Column) -> Column:
        norm = F.when(mean > 0, 1 - variant["b"] + variant["b"] * (lengths[f] / mean)).otherwise(1.0)
        each = F.arrays_zip(F.col("places").alias("places"), tf[f].alias("tf"), F.col(f"{f}_n").alias("n"))
        hit = lambda h: F.transform(h["places"], lambda at: F.struct(at.alias("at"), h["tf"].alias("tf"), h["n"].alias("n")))
        hits = F.array_sort(F.flatten(F.transform(F.filter(each, lambda h: h["tf"] > 0), hit)))
        return F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + idf(h["n"]) * (h["tf"] * (K1 + 1)) / (h["tf"] + K1 * norm))

    return variant["title"] * field("t", F.col("title_terms")) + variant["description"] * field("d", F.col("description_terms"))


def with_shares(
    narrow: DataFrame, stats: DataFrame, variants: dict[str, Variant] | DataFrame, kinds: dict[str, Idf] = IDF
) -> DataFrame:
    """One row per row and variant: ``variant`` and ``share``, the score over the search's ceiling.

    The ceiling is the score the query would get as a document of its own.
    """
    size = F.aggregate(F.transform("places", F.size), F.lit(0), lambda acc, n: acc + n)
    whole = F.transform("places", F.size)
    ceilings = stats.withColumn("variants", offered(variants)).withColumn(
        "variants",
        F.transform("variants", lambda v: F.struct(v.alias("v"), _score({"t": whole, "d": whole}, {"t": size, "d": size}, v, kinds).alias("ceiling"))),
    )
    told = lookup(narrow, ceilings.drop("terms"), KEYS, how="left").withColumn("_v", F.explode_outer("variants"))
    variant, ceiling = F.col("_v.v"), F.col("_v.ceiling")
    score = _score({f: F.col(f"{f}_tf") for f in "td"}, {f: F.col(f"{f}_length") for f in "td"}, variant, kinds)
    return told.select(
        *narrow.columns, variant["variant"].alias("variant"), F.when(ceiling > 0, score / ceiling).otherwise(0.0).alias("share")
    ).drop("t_tf", "d_tf")


def bonuses(query: Column, title: Column, description: Column) -> dict[str, Column]:
    """Exact-match bonuses by name."""
    asked, words = content_tokens(query), content_tokens(title)
    phrase = strip(F.lower(query))
    padded = lambda tokens: F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    some = F.size(asked) > 0
    give = lambda condition, value: F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)
    return {
        "exact_phrase_title": give(some & F.contains(padded(words), padded(asked)), 1.0),
        "query_substring_title": give((phrase != "") & F.contains(F.lower(title), phrase), 0.75),
        "query_substring_description": give((phrase != "") & F.contains(F.lower(description), phrase), 0.35),
        "all_terms_title": give(some & (F.size(F.array_except(asked, words)) == 0), 0.5),
    }


def with_bm25(
    results: DataFrame, searches: DataFrame, *, include_bonuses: bool = True, variant: Variant = Variant(), kinds: dict[str, Idf] = IDF
) -> DataFrame:
    """Add ``base_relevance`` and ``bm25``, the capped sum with the bonuses."""
    narrow = measured(results, searches)
    scored = with_shares(narrow, search_statistics(narrow, searches), {"core": variant}, kinds)
    scored = scored.drop("variant").withColumnRenamed("share", "base_relevance")
    names = list(bonuses(*[F.lit("")] * 3))
    total = F.col("base_relevance")
    for name in names if include_bonuses else ():
        total = total + F.col(name)
    scored = scored.withColumn("bm25", F.least(F.lit(1.0), total))
    return scored if include_bonuses else scored.drop(*names)


def bm25_order(score: str = "bm25") -> list[Column]:
    return [
        F.col(score).desc(),
        type_order(F.col("source_type"), WIDE_TYPE_ORDER),
        F.col("published_at").desc_nulls_last(),
        F.col("url"),
        F.col("id"),
    ]


def bm25_positions(results: DataFrame, searches: DataFrame, *, include_bonuses: bool = True, **kw) -> DataFrame:
    scored = with_bm25(results, searches, include_bonuses=include_bonuses)
    kw.setdefault("largest", largest_group(results, KEYS))
    return position(scored, KEYS, bm25_order(), **kw)


def variant_sweep(
    results: DataFrame, searches: DataFrame, grades: DataFrame, variants: dict[str, Variant] | DataFrame | None = None,
    kinds: dict[str, Idf] = IDF, **kw,
) -> DataFrame:
    """Mean quality of each variant; texts are read and counted once for all.

    ``variants`` may be a DataFrame (variant, title, description, b, idf), and ``kinds`` names what
    ``idf`` stands for: functions of the rows of a search and the rows that hold a term.
    """
    kw.setdefault("largest", largest_group(results, KEYS))
    narrow = measured(results, searches)
    shares = with_shares(narrow, search_statistics(narrow, searches), VARIANTS if variants is None else variants, kinds)
    grades = materialize(grades, "grades")
    wide = shares.select("search_id", "id", "source_type", "published_at", "url", "variant", F.col("share").alias("bm25"))
    keys = ["variant", *KEYS]
    placed = position(wide, keys, bm25_order(), **kw)
    return macro_means(ranking_metrics(placed, grades, keys), ["variant"])


def ranker_comparison(results: DataFrame, searches: DataFrame, grades: DataFrame, **kw) -> DataFrame:
    """Means of the lexical order, BM25 alone and with bonuses, and the differences to the first."""
    kw.setdefault("largest", largest_group(results, KEYS))
    columns = ["search_id", "id", "position"]
    grades = materialize(grades, "grades")
    ranked = [
        ("baseline", baseline_positions(results, searches, **kw)),
    ]
    weighted = materialize(with_bm25(results, searches), "bm25")
    for name, score in (("bm25_core", "base_relevance"), ("bm25_full", "bm25")):
        capped = weighted.withColumn("bm25", F.least(F.lit(1.0), F.col(score)))
        ranked.append((name, position(capped, KEYS, bm25_order(), **kw)))
    merged = None
    for name, df in ranked:
        part = df.select(F.lit(name).alias("ranker"), *columns)
        merged = part if merged is None else merged.unionByName(part)
    means = macro_means(ranking_metrics(merged, grades, ["ranker", *KEYS]), ["ranker"])
    # Three rows, one per ranker, whatever the data.
    every = Window.partitionBy(F.lit(0))
    first = lambda m: F.max(F.when(F.col("ranker") == "baseline", F.col(m))).over(every)
    return means.select(
        "ranker", "queries", *METRICS, *[(F.col(m) - first(m)).alias(f"delta_{m}") for m in METRICS]
    )


def _term_values(stats: DataFrame, idf: Idf) -> DataFrame:
    each = F.arrays_zip("terms", "places", "t_n", "d_n")
    told = stats.select("search_id", "documents", F.explode(each).alias("e"))
    return told.select(
        "search_id", F.explode("e.places").alias("at"), F.col("e.terms").alias("term"),
        idf(F.col("documents"), F.col("e.t_n")).alias("title_idf"), idf(F.col("documents"), F.col("e.d_n")).alias("description_idf"),
    )


def term_idf(results: DataFrame, searches: DataFrame, idf: Idf = IDF["smooth1"]) -> DataFrame:
    """Inverse document frequency of each query term in both fields, by place in the query."""
    narrow = measured(results, searches)
    return _term_values(search_statistics(narrow, searches), idf)


def _both(results: DataFrame, searches: DataFrame, grades: DataFrame, scored: DataFrame, **kw) -> DataFrame:
    lexical = baseline_positions(results, searches, **kw).select(
        "search_id", "id", "title", "raw_relevance", F.col("position").alias("lexical_at")
    )
    weighted = position(scored, KEYS, bm25_order(), **kw).select(
        "search_id", "id", "bm25", F.col("position").alias("bm25_at")
    )
    return with_grades(lexical.join(weighted, ["search_id", "id"]), grades)


def both_positions(results: DataFrame, searches: DataFrame, grades: DataFrame, **kw) -> DataFrame:
    """Each graded result with its place in the lexical and in the BM25 order."""
    kw.setdefault("largest", largest_group(results, KEYS))
    return _both(results, searches, grades, with_bm25(results, searches, include_bonuses=False), **kw)


def rank_shifts(both: DataFrame) -> DataFrame:
    """How far each relevant result moves from the lexical to the BM25 order."""
    return both.filter(F.col("rel") >= 1).withColumn("shift", F.col("bm25_at") - F.col("lexical_at"))


def relevant_in_top10(both: DataFrame) -> DataFrame:
    hit = F.col("rel") >= 1
    return both.groupBy(*KEYS).agg(
        F.count_if(hit & (F.col("lexical_at") <= 10)).alias("lexical"),
        F.count_if(hit & (F.col("bm25_at") <= 10)).alias("bm25"),
    )


def harmful_inversions(both: DataFrame) -> DataFrame:
    """Pairs of different grades in both top tens whose order the two rankers disagree on.

    Only the ten rows a search can have in both lists are joined to each other.
    """
    top = both.filter((F.col("lexical_at") <= 10) & (F.col("bm25_at") <= 10))
    fields = ("id", "rel", "lexical_at", "bm25_at", "raw_relevance", "bm25", "title")
    worse = top.select("search_id", *[F.col(c).alias(f"worse_{c}") for c in fields])
    better = top.select("search_id", *[F.col(c).alias(f"better_{c}") for c in fields])
    pairs = better.join(worse, "search_id").filter(
        (F.col("better_rel") > F.col("worse_rel"))
        & (
            (F.col("better_lexical_at") < F.col("worse_lexical_at"))
            != (F.col("better_bm25_at") < F.col("worse_bm25_at"))
        )
    )
    return (
        pairs.withColumn("gap", F.col("better_rel") - F.col("worse_rel"))
        .withColumn("better_title", shorten(F.col("better_title")))
        .withColumn("worse_title", shorten(F.col("worse_title")))
    )


def forensic_report(results: DataFrame, searches: DataFrame, grades: DataFrame, idf: Idf = IDF["smooth1"], **kw) -> DataFrame:
    """One job's account of both rankers: (part, search_id, place, item, other, value).

    Parts are ``idf_title`` and ``idf_description`` (item: a term of the query, by place), ``lexical_top``
    and ``bm25_top`` (item: a result, value: its score), ``shift`` (item: a relevant result, place: in the BM25 order,
    value: how far it moved) and ``inversion`` (item and other: results of better and worse grade, place: of the
    better one in the BM25 order, value: the difference of grades). Texts are measured once and the two orders are joined
    and written once; every part is read from these.
    """
    kw.setdefault("largest", largest_group(results, KEYS))
    narrow = measured(results, searches)
    stats = materialize(search_statistics(narrow, searches), "statistics")
    scored = with_shares(narrow, stats, {"core": Variant()}, IDF).withColumn("bm25", F.least(F.lit(1.0), F.col("share")))
    both = materialize(_both(results, searches, grades, scored, **kw), "both")

    def entry(part: str, place: Column, item: Column, value: Column, other: Column = F.lit(None)) -> Column:
        return F.struct(
            F.lit(part).alias("part"), place.cast("long").alias("place"), item.cast("string").alias("item"),
            other.cast("string").alias("other"), value.cast("double").alias("value"),
        )

    def told(frame: DataFrame, *entries: Column) -> DataFrame:
        return frame.select("search_id", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.part", "search_id", "e.place", "e.item", "e.other", "e.value")

    lexical, weighted, item = F.col("lexical_at"), F.col("bm25_at"), F.col("id")
    orders = told(
        both,
        F.when(lexical <= 10, entry("lexical_top", lexical, item, F.col("raw_relevance"))),
        F.when(weighted <= 10, entry("bm25_top", weighted, item, F.col("bm25"))),
        F.when(F.col("rel") >= 1, entry("shift", weighted, item, weighted - lexical)),
    )
    terms = told(
        _term_values(stats, idf),
        entry("idf_title", F.col("at"), F.col("term"), F.col("title_idf")),
        entry("idf_description", F.col("at"), F.col("term"), F.col("description_idf")),
    )
    inversions = told(
        harmful_inversions(both),
        entry("inversion", F.col("better_bm25_at"), F.col("better_id"), F.col("gap"), F.col("worse_id")),
    )
    return orders.unionByName(terms).unionByName(inversions)


def grade_histogram(grades: DataFrame) -> DataFrame:
    return grades.groupBy(*KEYS).pivot("rel", [0, 1, 2]).count().na.fill(0)
