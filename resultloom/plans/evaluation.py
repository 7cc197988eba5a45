"""Retrieval and dedup quality against labels."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultloom.functions.scoring import (
    DECAY_CANDIDATES,
    WEIGHT_SETS,
    Decay,
    age_hours,
    freshness,
    freshness_by,
    instant,
)
from resultloom.operators.ranking import (
    KEYS,
    alternate_types,
    score_order,
    with_bands,
    with_components,
)
from resultloom.operators.skew import largest_group, lookup, position
from resultloom.operators.statistics import median, spearman
from resultloom.operators.views import recent
from resultloom.runtime import materialize

METRICS = ("precision_at_5", "precision_at_10", "reciprocal_rank", "ndcg_at_10")

# Weight set and diversity of each ranking candidate.
RANKING_CANDIDATES = {
    "C0_relevance_only": ("relevance_only", False),
    "C1_design": ("design", False),
    "C2_balanced": ("balanced", False),
    "C3_relevance_heavy": ("relevance_heavy", False),
    "C4_design_diversity": ("design", True),
}

# The filter settings compared.
FILTER_CONFIGS = {
    "F0_default": {},
    "F1_news_only": {"source_types": ["news"]},
    "F2_social_only": {"source_types": ["social"]},
    "F3_reference_only": {"source_types": ["reference"]},
    "F4_time_24h": {"hours": 24},
    "F5_time_7d": {"hours": 168},
    "F6_time_30d": {"hours": 720},
    "F7_duplicates_canonical": {"canonical": True},
    "F8_news_time_7d": {"source_types": ["news"], "hours": 168},
    "F9_news_social_time_24h": {"source_types": ["news", "social"], "hours": 24},
    "F10_language_en": {"language": "en"},
}


def gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1.0


def discount(place: Column) -> Column:
    return F.log2(place + 1.0)


def with_grades(ranked: DataFrame, grades: DataFrame) -> DataFrame:
    """Add ``rel``; an item without a label is grade 0."""
    joined = ranked.join(grades.select("search_id", "id", "rel"), ["search_id", "id"], "left")
    return joined.withColumn("rel", F.coalesce("rel", F.lit(0)))


def ideal_gain(grades: DataFrame, k: int = 10) -> DataFrame:
    """Discounted gain of the best order of a search's labels, from how many there are of each."""
    counts = grades.groupBy(*KEYS).agg(
        F.count_if(F.col("rel") == 2).alias("twos"), F.count_if(F.col("rel") >= 1).alias("hits")
    )
    def at(i: Column) -> Column:
        grade = F.when(i <= F.col("twos"), 3.0).when(i <= F.col("hits"), 1.0).otherwise(0.0)
        return grade / discount(i)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, i: acc + at(i))
    return counts.select(*KEYS, total.alias("idcg"))


def ranking_metrics(
    ranked: DataFrame, grades: DataFrame, keys: Sequence[str] = KEYS, extra: Sequence[Column] = ()
) -> DataFrame:
    """P@5, P@10, reciprocal rank and nDCG@10 per group of ``keys`` (one is search_id).

    ``ranked`` has a 1-based ``position``. Everything is one aggregate of partial
    sums; P@k divides by k even when fewer items exist, and the ideal order is
    that of all labels of the search, also for a filtered view.
    """
    place, hit = F.col("position"), F.col("rel") >= 1
    sums = with_grades(ranked, grades).groupBy(*keys).agg(
        (F.count_if((place <= 5) & hit) / 5).alias("precision_at_5"),
        (F.count_if((place <= 10) & hit) / 10).alias("precision_at_10"),
        F.coalesce(1.0 / F.min(F.when(hit, place)), F.lit(0.0)).alias("reciprocal_rank"),
        F.sum(F.when(place <= 10, gain(F.col("rel")) / discount(place)).otherwise(0.0)).alias("dcg"),
        *extra,
    )
    return (
        sums.join(ideal_gain(grades), list(KEYS), "left")
        .withColumn("ndcg_at_10", F.coalesce(F.col("dcg") / F.nullif("idcg", F.lit(0.0)), F.lit(0.0)))
        .drop("dcg", "idcg")
    )


def macro_means(metrics: DataFrame, keys: Sequence[str] = (), names: Sequence[str] = METRICS) -> DataFrame:
    """Means over searches."""
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in names]
    )


Scorer = Callable[[Column, Column, Column, Column], Column]


def weighted_sum(relevance: Column, fresh: Column, quality: Column, weights: Column) -> Column:
    """The parts times the weights of the row's source type, a struct."""
    return weights["relevance"] * relevance + weights["freshness"] * fresh + weights["quality"] * quality


def known_candidates(results: DataFrame) -> DataFrame:
    """The fixed candidates as rows (candidate, diverse, source_type, relevance, freshness, quality)."""
    rows = [
        (name, diverse, kind, *map(float, w))
        for name, (weights, diverse) in RANKING_CANDIDATES.items()
        for kind, w in WEIGHT_SETS[weights].items()
    ]
    return results.sparkSession.createDataFrame(
        rows, "candidate string, diverse boolean, source_type string, relevance double, freshness double, quality double"
    )


def candidate_positions(
    results: DataFrame, searches: DataFrame, now: datetime | str, candidates: DataFrame | None = None,
    scorer: Scorer = weighted_sum, **kw,
) -> DataFrame:
    """Every result placed by each ranking candidate; components are computed once.

    ``candidates`` has a row per candidate and source type with its weights, and whether the candidate
    mixes types; a type it does not name has the weights of news. They are gathered by a subquery into one
    value, so the plan is the same for any number of them. ``scorer`` makes the score from relevance,
    freshness, quality and those weights.
    """
    largest = kw.pop("largest", None) or largest_group(results, KEYS)
    parts = with_components(results, searches, now).withColumn("scored_type", F.col("source_type"))
    weights = F.struct(*[F.col(c).cast("double").alias(c) for c in ("relevance", "freshness", "quality")])
    offered = (known_candidates(results) if candidates is None else candidates).groupBy("candidate", "diverse").agg(
        F.map_from_entries(F.collect_list(F.struct("source_type", weights))).alias("weights")
    )
    every = offered.agg(F.collect_list(F.struct("candidate", "diverse", "weights"))).scalar()
    wide = parts.select(
        "search_id", "id", "source_type", "published_at", "url", "relevance", "freshness", "quality", F.explode(every).alias("c")
    )
    own = F.coalesce(F.try_element_at("c.weights", F.col("source_type")), F.try_element_at("c.weights", F.lit("news")))
    wide = wide.select(
        "search_id", "id", "source_type", "published_at", "url", "freshness", "c.candidate", "c.diverse",
        scorer(F.col("relevance"), F.col("freshness"), F.col("quality"), own).alias("rank_score"),
    )
    keys = ["candidate", *KEYS]
    plain = position(wide.filter(~F.col("diverse")), keys, score_order(), largest=largest, **kw)
    banded = with_bands(wide.filter("diverse"), keys, largest=largest, **kw)
    mixed = alternate_types(banded, keys, out="position", largest=largest, **kw).withColumn(
        "position", F.col("position") + 1
    )
    names = [*keys, "id", "freshness", "position"]
    return plain.select(names).unionByName(mixed.select(names))


def junk_counts() -> list[Column]:
    """Irrelevant, and irrelevant but fresh, items among the first ten."""
    top_miss = (F.col("position") <= 10) & (F.col("rel") == 0)
    return [
        F.count_if(top_miss).alias("rel0_in_top10"),
        F.count_if(top_miss & (F.col("freshness") >= 0.7)).alias("fresh_junk_in_top10"),
    ]


def candidate_sweep(
    results: DataFrame, searches: DataFrame, grades: DataFrame, now: datetime | str, candidates: DataFrame | None = None,
    scorer: Scorer = weighted_sum, **kw,
) -> DataFrame:
    """Mean quality of each ranking candidate; see ``candidate_positions`` for ``candidates`` and ``scorer``."""
    placed = candidate_positions(results, searches, now, candidates, scorer, **kw)
    grades = materialize(grades, "grades")
    per_query = ranking_metrics(placed, grades, ["candidate", *KEYS], junk_counts())
    return macro_means(per_query, ["candidate"], [*METRICS, "rel0_in_top10", "fresh_junk_in_top10"])


def gold_annotations(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Mark gold duplicates; the canonical row is the least (source name, URL)."""
    members = results.select("search_id", "id", "source_name", "url").join(
        gold.select("id", "group_id"), "id"
    )
    least = members.groupBy("search_id", "group_id").agg(
        F.count("*").alias("_n"), F.min(F.struct("source_name", "url", "id")).alias("_best")
    )
    return (
        lookup(members, least.filter(F.col("_n") > 1), ["search_id", "group_id"])
        .select("search_id", "id", "group_id", (F.col("id") != F.col("_best.id")).alias("is_duplicate"))
    )


def _passes(config: dict, since: dict[int, Column]) -> Column:
    keep = F.lit(True)
    if "source_types" in config:
        keep = keep & F.col("source_type").isin(*config["source_types"])
    if "language" in config:
        keep = keep & F.coalesce(F.col("language") == config["language"], F.lit(False))
    if config.get("canonical"):
        keep = keep & ~F.col("is_duplicate")
    if "hours" in config:
        keep = keep & recent(since[config["hours"]])
    return keep


def filter_sweep(
    ranked: DataFrame, grades: DataFrame, now: datetime | str, **kw
) -> DataFrame:
    """Mean quality and coverage of each filter setting over one stored order.

    A row goes, in one pass, to every view that keeps it. A search with an empty
    view counts with zeros.
    """
    largest = kw.pop("largest", None) or largest_group(ranked, KEYS)
    grades = materialize(grades, "grades")
    since = {h: instant(now) - F.expr(f"INTERVAL {h} HOURS") for h in (24, 168, 720)}
    names = F.array_compact(
        F.array(*[F.when(_passes(c, since), F.lit(n)) for n, c in FILTER_CONFIGS.items()])
    )
    views = ranked.select("search_id", "id", "rank_position", "freshness", F.explode(names).alias("view"))
    keys = ["view", *KEYS]
    placed = position(views, keys, [F.col("rank_position")], largest=largest, **kw)
    kept = [
        F.count("*").alias("kept"),
        F.count_if(F.col("rel") >= 1).alias("kept1"),
        F.count_if(F.col("rel") >= 2).alias("kept2"),
        *junk_counts(),
    ]
    measured = ranking_metrics(placed, grades, keys, kept)
    totals = grades.groupBy(*KEYS).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("rel") >= 1).alias("all1"),
        F.count_if(F.col("rel") >= 2).alias("all2"),
    )
    every = totals.withColumn("view", F.explode(F.array(*[F.lit(n) for n in FILTER_CONFIGS])))
    counts = ["kept", "kept1", "kept2", "rel0_in_top10", "fresh_junk_in_top10"]
    told = every.join(measured, keys, "left").na.fill(0, [*counts, *METRICS])
    covered = told.withColumn(
        "rel1_coverage", F.coalesce(F.col("kept1") / F.nullif("all1", F.lit(0)), F.lit(1.0))
    ).withColumn("rel2_coverage", F.coalesce(F.col("kept2") / F.nullif("all2", F.lit(0)), F.lit(1.0)))
    means = ["kept", "total", "rel1_coverage", "rel2_coverage", *METRICS, "rel0_in_top10", "fresh_junk_in_top10"]
    return macro_means(covered, ["view"], means)


def language_coverage(results: DataFrame) -> DataFrame:
    """Rows with and without a language by source, and over all (source null)."""
    return results.rollup("source_name").agg(
        F.count("*").alias("rows"), F.count("language").alias("with_language")
    ).withColumn("coverage", F.col("with_language") / F.col("rows"))


# --- freshness curves ------------------------------------------------------


Curve = Callable[[Column, Column, Column], Column]


def _value(curve: Decay | Curve, published_at: Column, source_type: Column, now: Column) -> Column:
    if isinstance(curve, Decay):
        return freshness(published_at, source_type, now, curve, strict=False)
    return curve(published_at, source_type, now)


def curve_scores(
    items: DataFrame, now: datetime | str, curves: dict[str, Decay | Curve] | DataFrame = DECAY_CANDIDATES
) -> DataFrame:
    """Each item scored by each curve, one row per pair.

    A curve is a ``Decay``, or a function of publication, source type and instant. ``curves`` may also be
    a DataFrame with ``curve`` and the fields of ``Decay``, gathered by a subquery into one value.
    """
    named = ("search_id", "id", "source_type", "rel")
    published, kind, at = F.col("published_at"), F.col("source_type"), instant(now)
    if isinstance(curves, DataFrame):
        fields = [F.col(f.name).cast("string" if f.name == "shape" else "double").alias(f.name) for f in dataclasses.fields(Decay)]
        every = curves.agg(F.collect_list(F.struct("curve", *fields))).scalar()
        wide = items.select(*named, "published_at", F.explode(every).alias("c"))
        return wide.select(*named, "c.curve", freshness_by(published, kind, at, F.col("c")).alias("fresh"))
    scored = F.array(*[F.struct(F.lit(name).alias("curve"), _value(c, published, kind, at).alias("fresh")) for name, c in curves.items()])
    return items.select(*named, F.explode(scored).alias("c")).select(*named, "c.*")


def curve_distributions(scores: DataFrame, **kw) -> DataFrame:
    """n, min, median, max and the share below 0.5, by curve and source type."""
    keys = ["curve", "source_type"]
    summary = scores.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("fresh").alias("min"),
        F.max("fresh").alias("max"),
        F.avg(F.when(F.col("fresh") < 0.5, 100.0).otherwise(0.0)).alias("pct_below_half"),
    )
    return summary.join(median(scores, keys, "fresh", "median", **kw), keys)


def curve_tension(scores: DataFrame) -> DataFrame:
    """Where freshness and relevance pull apart."""
    fresh, rel = F.col("fresh"), F.col("rel")
    return scores.groupBy("curve").agg(
        F.count_if((rel == 0) & (fresh >= 0.9)).alias("irrelevant_fresh_09"),
        F.count_if((rel == 0) & (fresh >= 0.7)).alias("irrelevant_fresh_07"),
        F.count_if((rel >= 1) & (fresh < 0.5)).alias("relevant_old"),
    )


def curve_correlation(scores: DataFrame, **kw) -> DataFrame:
    """Rank correlation of freshness and grade, by source type and over all (type 'all')."""
    both = scores.withColumn(
        "source_type", F.explode(F.array(F.lit("all"), F.col("source_type")))
    )
    return spearman(both, ["curve", "source_type"], "fresh", "rel", **kw)


def curve_grid(spark_rows: DataFrame, ages: Sequence[float], curves: dict[str, Decay] = DECAY_CANDIDATES) -> DataFrame:
    """Each curve at the given ages for every source type found in ``spark_rows``."""
    now = instant("2024-01-01 00:00:00")
    grid = (
        spark_rows.select("source_type")
        .distinct()
        .withColumn("age_hours", F.explode(F.array(*[F.lit(float(a)) for a in ages])))
        .withColumn("published_at", F.timestamp_micros(F.unix_micros(now) - (F.col("age_hours") * 3.6e9).cast("long")))
    )
    columns = [
        freshness(F.col("published_at"), F.col("source_type"), now, d, strict=False).alias(n)
        for n, d in curves.items()
    ]
    return grid.select("source_type", "age_hours", *columns)


def freshness_invariants(
    items: DataFrame, now: datetime | str, decay: Decay | Curve = Decay(), score: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Whether a curve keeps its promises on every item.

    ``retrieved_at_ignored`` scores the items and a twin of them that was retrieved years later,
    and compares the two null for null. ``score`` adds the column ``fresh`` to a frame of items, by
    default by ``decay``; it sees all columns, so a use of ``retrieved_at`` shows.
    """
    at = instant(now)
    kind, pub = F.col("source_type"), F.col("published_at")
    value = lambda when, then=at: _value(decay, when, kind, then)
    here, older, present = value(pub), value(pub - F.expr("INTERVAL 1 HOUR")), value(at)
    future, untimed = value(at + F.expr("INTERVAL 1 DAY")), value(F.lit(None).cast("timestamp"))
    promises = items.agg(
        F.bool_and(untimed.between(0.0, 1.0)).alias("missing_timestamp_handled"),
        F.bool_and(here.between(0.0, 1.0)).alias("bounded"),
        F.bool_and(F.coalesce(older <= here, F.lit(True))).alias("monotonic_with_age"),
        F.bool_and(future <= present + 1e-9).alias("future_clamped"),
    )
    score = score or (lambda frame: frame.withColumn("fresh", value(pub)))
    twin = items.withColumn("retrieved_at", F.col("retrieved_at") + F.expr("INTERVAL 3 YEARS"))
    mine = score(items).select(*KEYS, "id", F.col("fresh").alias("_mine"))
    other = score(twin).select(*KEYS, "id", F.col("fresh").alias("_other"))
    same = mine.join(other, [*KEYS, "id"], "full").agg(
        F.bool_and(F.col("_mine").eqNullSafe(F.col("_other"))).alias("same")
    )
    return promises.withColumn("retrieved_at_ignored", same.scalar())


def freshest(items: DataFrame, now: datetime | str, limit: int = 10) -> DataFrame:
    """The newest items, those without a time last."""
    order = [F.col("published_at").desc_nulls_last(), F.col("id")]
    return items.orderBy(*order).limit(limit).withColumn(
        "age_hours", F.round(age_hours(F.col("published_at"), instant(now)), 2)
    )


def span_days(items: DataFrame, now: datetime | str) -> DataFrame:
    """Whole days from the oldest publication to ``now``."""
    micros = F.unix_micros(instant(now)) - F.min(F.unix_micros("published_at"))
    return items.agg(F.floor(micros / 86_400_000_000).alias("span_days"))


# --- duplicate pairs -------------------------------------------------------


def pair_counts(labels: DataFrame, keys: Sequence[str], by: Sequence[str], out: str) -> DataFrame:
    """Unordered pairs sharing all of ``by``, counted from group sizes, never formed."""
    named = labels
    for name in by:
        named = named.filter(F.col(name).isNotNull())
    n = F.col("n")
    sizes = named.groupBy(*dict.fromkeys([*keys, *by])).agg(F.count("*").alias("n"))
    return sizes.groupBy(*keys).agg(F.sum((n * (n - 1) / 2).cast("long")).alias(out))


def dedup_counts(
    labels: DataFrame,
    predicted: Sequence[str],
    ambiguous: DataFrame | None = None,
    gold: str = "gold",
) -> DataFrame:
    """Per search: gold, predicted and shared pairs, ambiguous pairs taken out of all.

    ``labels`` has search_id, id, a gold column and one column per predicted
    grouping; a pair is predicted when any grouping joins it. With one or two
    groupings, counts follow from group sizes by inclusion and exclusion.
    """
    if len(predicted) not in (1, 2):
        raise ValueError("one or two predicted groupings")
    keys = ["search_id"]
    terms = [([p], 1) for p in predicted] + ([(list(predicted), -1)] if len(predicted) == 2 else [])
    out = labels.select(*keys).distinct()
    out = out.join(pair_counts(labels, keys, [gold], "g"), keys, "left")
    p_sum, s_sum = F.lit(0), F.lit(0)
    for i, (cols, sign) in enumerate(terms):
        out = out.join(pair_counts(labels, keys, cols, f"p{i}"), keys, "left")
        out = out.join(pair_counts(labels, keys, [gold, *cols], f"s{i}"), keys, "left")
        p_sum = p_sum + sign * F.coalesce(F.col(f"p{i}"), F.lit(0))
        s_sum = s_sum + sign * F.coalesce(F.col(f"s{i}"), F.lit(0))
    out = out.select(
        *keys,
        F.coalesce("g", F.lit(0)).alias("gold_pairs"),
        p_sum.alias("predicted_pairs"),
        s_sum.alias("shared_pairs"),
    )
    if ambiguous is None:
        return out
    unclear = ambiguous_pairs(labels, ambiguous, predicted, gold).groupBy(*keys).agg(
        F.count_if("in_gold").alias("ag"),
        F.count_if("in_predicted").alias("ap"),
        F.count_if(F.col("in_gold") & F.col("in_predicted")).alias("ab"),
    )
    joined = out.join(unclear, keys, "left").na.fill(0, ["ag", "ap", "ab"])
    return joined.select(
        *keys,
        (F.col("gold_pairs") - F.col("ag")).alias("gold_pairs"),
        (F.col("predicted_pairs") - F.col("ap")).alias("predicted_pairs"),
        (F.col("shared_pairs") - F.col("ab")).alias("shared_pairs"),
    )


def unordered(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct pairs with the lesser id first."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def ambiguous_pairs(
    labels: DataFrame, ambiguous: DataFrame, predicted: Sequence[str], gold: str = "gold"
) -> DataFrame:
    """Each listed pair with whether gold, and whether any predicted grouping, joins it."""
    cols = [gold, *predicted]
    side = lambda s: labels.select(
        F.col("search_id").alias("search_id" if s == "a" else "_search"),
        F.col("id").alias(s),
        *[F.col(c).alias(f"{c}_{s}") for c in cols],
    )
    joined = (
        unordered(ambiguous).join(side("a"), "a").join(side("b"), "b")
        .filter(F.col("search_id") == F.col("_search"))
    )
    same = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False))
    either = same(predicted[0])
    for name in predicted[1:]:
        either = either | same(name)
    return joined.select("search_id", "a", "b", same(gold).alias("in_gold"), either.alias("in_predicted"))


def dedup_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 over all pairs; 0 where undefined."""
    summed = counts.agg(
        F.sum("shared_pairs").alias("true_positive"),
        F.sum(F.col("predicted_pairs") - F.col("shared_pairs")).alias("false_positive"),
        F.sum(F.col("gold_pairs") - F.col("shared_pairs")).alias("false_negative"),
    )
    tp = F.col("true_positive")
    share = lambda other: F.coalesce(tp / F.nullif(tp + F.col(other), F.lit(0)), F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    return (
        summed.withColumn("precision", share("false_positive"))
        .withColumn("recall", share("false_negative"))
        .withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))
    )
