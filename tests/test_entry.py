import __spark_entry__ as entry


def test_every_reference_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["search_id", "id", "rank_score", "rank_position"]
    assert df.count() == 200
