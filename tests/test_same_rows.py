from resultloom.bindings import queries
from resultloom.bindings.tables import Tables


def test_rows_are_dealt_anew_in_parts_of_the_session(spark, monkeypatch):
    dealt, plain = [], queries.ranking.baseline_positions
    monkeypatch.setattr(queries.ranking, "baseline_positions", lambda results, searches: (dealt.append(results), plain(results, searches))[1])
    found = queries.QUERIES["u7_same_rows"](Tables(spark, "/root/testdata/sf0.001"))
    assert found.first().differences == 0
    plan = dealt[1]._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan and "hashpartitioning(title" in plan and ", 7)" not in plan
