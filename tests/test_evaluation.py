import pytest
from pyspark.sql import functions as F

from resultloom.bindings.tables import NOW, Tables
from resultloom.functions.scoring import DECAY_CANDIDATES, Decay
from resultloom.plans import bm25, evaluation

FLAGS = ["missing_timestamp_handled", "bounded", "monotonic_with_age", "future_clamped", "retrieved_at_ignored"]


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def flags(found):
    row = found.first()
    return [row[name] for name in FLAGS]


def test_invariants_and_planted_faults(tables):
    items = tables.results()
    assert flags(evaluation.freshness_invariants(items, NOW)) == [True] * 5
    leaky = lambda frame: frame.withColumn("fresh", F.when(F.year("retrieved_at") > 2025, 0.1).otherwise(0.2))
    assert flags(evaluation.freshness_invariants(items, NOW, score=leaky))[4] is False
    gone = lambda frame: frame.withColumn("fresh", F.when(F.year("retrieved_at") <= 2025, 0.2))
    assert flags(evaluation.freshness_invariants(items, NOW, score=gone))[4] is False
    rising = lambda published, kind, now: F.coalesce((F.unix_seconds(now) - F.unix_seconds(published)) / 1e9, F.lit(2.0))
    assert flags(evaluation.freshness_invariants(items, NOW, rising))[:3] == [False, False, False]


def test_curves_as_rows_equal_curves_as_arguments(spark, tables):
    items = tables.results().withColumn("rel", F.lit(0))
    rows = [(n, d.shape, d.news_half_life, d.social_half_life, d.floor, d.reference, d.missing) for n, d in DECAY_CANDIDATES.items()]
    named = spark.createDataFrame(rows, "curve string, shape string, news_half_life double, social_half_life double, floor double, reference double, missing double")
    shown = lambda frame: sorted((r.curve, r.id, round(r.fresh, 12)) for r in frame.collect())
    assert shown(evaluation.curve_scores(items, NOW, named)) == shown(evaluation.curve_scores(items, NOW))
    assert shown(evaluation.curve_scores(items, NOW, {"x": Decay(floor=0.5)}))[0][0] == "x"


def test_plans_do_not_grow_with_candidates(spark, tables):
    def size(frame):
        return len(frame._jdf.queryExecution().analyzed().toString())

    items = tables.results().withColumn("rel", F.lit(0))
    schema = "curve string, shape string, news_half_life double, social_half_life double, floor double, reference double, missing double"
    few, many = [spark.range(n).selectExpr("concat('c', id) AS curve", "'exp' AS shape", "id + 1.0 AS news_half_life", "1.0 AS social_half_life", "0.1 AS floor", "0.5 AS reference", "0.2 AS missing") for n in (2, 500)]
    assert set(schema.replace(" string", "").replace(" double", "").split(", ")) == set(few.columns)
    small, large = evaluation.curve_scores(items, NOW, few), evaluation.curve_scores(items, NOW, many)
    assert large.count() == 250 * small.count()
    assert abs(size(large) - size(small)) < 100


def test_an_unknown_idf_is_an_error(tables):
    variants = {"odd": bm25.Variant(idf="none such")}
    with pytest.raises(Exception, match="unknown idf"):
        bm25.variant_sweep(tables.results(), tables.searches(), tables.grades(), variants).collect()


def test_forensic_report_parts(tables):
    report = bm25.forensic_report(tables.results(), tables.searches(), tables.grades())
    assert report.columns == ["part", "search_id", "place", "item", "other", "value"]
    parts = {r.part: r.n for r in report.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert {"idf_title", "idf_description", "lexical_top", "bm25_top", "shift"} <= set(parts) and parts["lexical_top"] == parts["bm25_top"]
