import zlib

from pyspark.sql import functions as F

from resultloom.llm import toxicity
from resultloom.llm.bindings import op6_toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    got = {r.doc_id: r for r in op6_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    right = sum(a == b for a, b in out)
    assert right / len(out) >= 0.85
    hits = [p for a, p in out if a]
    assert sum(hits) / len(hits) >= 0.4


def test_grams_and_odd_rows(spark):
    found = [(o.tolist(), len(set(f.tolist()))) for o, f in toxicity.grams(["ab", None], (3,), 64)]
    assert found[0][0] == [0, 0]
    words = ["vile", "rotten", "nice", "calm"]
    rows = [(i, f"this is a {words[i % 4]} thing {i} said to be {words[i % 4]}", i % 4 < 2) for i in range(200)]
    rows += [(500, None, False), (501, "", False), (502, "vile " * 20000, True), (503, "😀 vile", True), (None, "vile", True)]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t, _ in rows], "doc_id long, text string, toxic int, _score double")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows] + [(0, None), (1, 0), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, dimensions=1 << 14)
    again = toxicity.train(docs.repartition(3), labels, dimensions=1 << 14)
    assert (model.weights == again.weights).all() and model.bias == again.bias
    scored = toxicity.score(docs, model, "p")
    assert scored.columns == [*docs.columns, "p"] and scored.count() == len(rows)
    for r in scored.collect():
        assert (r.p >= 0.5) == ("vile" in (r.text or "") or "rotten" in (r.text or ""))
    none = toxicity.train(docs, labels.limit(0))
    assert not none.weights.any()
    assert toxicity.score(docs.limit(0), none).collect() == []
    assert max(r.p for r in toxicity.score(docs, none, "p").collect()) < 1e-9
    clean = toxicity.train(docs, labels.filter("toxic = 0"), dimensions=1 << 14)
    assert max(r.p for r in toxicity.score(docs, clean, "p").collect()) < 1e-9
    assert docs.filter(toxicity.held_out("doc_id", 4)).filter(F.col("doc_id").isNull()).count() == 0
