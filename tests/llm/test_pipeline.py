import re

import pytest
from test_overlap import brute as brute_near
from test_short_lines import brute_whole as brute_lines

import corpus_pipeline
from resultloom.llm import mixing, toxicity

TESTDATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet(f"{TESTDATA}/documents.parquet").limit(70).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{TESTDATA}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def as_dict(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, before, seen = dict(corpus_pipeline.STAGES), as_dict(docs), {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.materialize(stage(spark, frame, folder), "test")
        seen[name] = frame
    assert list(stages) == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    assert all(seen[n].columns == COLUMNS for n in list(stages)[:-1])

    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~toxicity.held_out("doc_id", 4))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    calm = as_dict(seen["toxicity"])
    assert calm == {i: r for i, r in before.items() if scores[i] < toxicity.THRESHOLD}

    removed = {i: gone for i, _, gone in brute_lines([(i, r.text) for i, r in calm.items()])}
    want = {}
    for i, r in calm.items():
        text = "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in removed[i])
        if not removed[i] or text.strip():
            want[i] = (text, len(text))
    clean = as_dict(seen["line dedup"])
    assert {i: (r.text, r.n_chars) for i, r in clean.items()} == want

    near = as_dict(seen["near dedup"])
    assert sorted(near) == brute_near([(i, r.text) for i, r in clean.items()])[0]
    assert all(near[i] == clean[i] for i in near)

    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    safe = as_dict(seen["decontamination"])
    assert safe == {i: r for i, r in near.items() if not any(x in norm(r.text) for x in items)}

    copies = {r.doc_id: r.copies for r in mixing.mix(seen["near dedup"].sparkSession.createDataFrame(list(safe.values()), seen["near dedup"].schema)).collect()}
    rows = [(r.doc_id, r.mix_epoch) for r in seen["mixing"].collect()]
    assert sorted(rows) == sorted((i, n + 1) for i, c in copies.items() for n in range(c))
    assert corpus_pipeline.run(spark, folder).count() == len(rows)


def test_odd_tables(spark, tmp_path):
    line = "a line that stands in more than one document here"
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, line, "en", "a"), (4, line, "en", None), (4, line, "en", None), (None, "null id with words of its own", "en", "b"),
            (5, "long " * 20000, "en", "b"), (6, " \n\t", "en", "b")]
    docs = spark.createDataFrame([(i, t, g, s, len(t or ""), "x", 1, 2) for i, t, g, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, row string, hash int, removed int")
    docs.write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/t/labels.parquet")
    spark.createDataFrame([(1, None), (2, "unseen item")], "item_id long, text string").write.parquet(f"{tmp_path}/t/benchmark.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.materialize(stage(spark, frame, f"{tmp_path}/t"), "odd")
        assert frame.columns[:8] == docs.columns
        if name == "near dedup":
            # The line stays once, of texts without words one row, and the others as they are.
            assert sorted(str(r.doc_id) for r in frame.collect()) == ["1", "3", "5", "None"]
    assert {r.doc_id for r in frame.collect()} <= {3, 5, None}
    frame = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.materialize(stage(spark, frame, f"{tmp_path}/t"), "none")
    assert frame.count() == 0
