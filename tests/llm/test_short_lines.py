import corpus_pipeline
from resultloom.llm.bindings import op9_line_dedup
from test_lines import brute

TESTDATA = "/root/testdata/sf0.001"


def brute_whole(rows):
    """Equal lines of any length, besides those of 15 characters within one edit."""
    seen, out = set(), []
    near = {i: gone for i, _, gone in brute(rows)}
    for i, text in sorted(rows):
        removed = set(near[i])
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if line and line in seen:
                removed.add(n)
            seen.add(line)
        out.append((i, len(text.split("\n")) if text else 0, sorted(removed)))
    return out


def test_equal_short_lines_go(spark, tmp_path):
    line = "a line that is long enough"
    rows = [(1, f"Hi.\n\nLes.\nHi.\n{line}"), (2, f"les.\n \t\n Les.\r\nä\n{line}s"), (3, "ä\nx"), (4, "Hi."), (5, None), (6, "\n\n"), (7, "fourteen chars\nfourteen charz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_whole(rows)
    assert [r[2] for r in want] == [[3], [2, 4], [0], [0], [], [], []]
    got = op9_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_lines, list(r.removed)) for r in got) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert kept == {1: f"Hi.\n\nLes.\n{line}", 2: "les.\n \t\nä", 3: "x", 5: None, 6: "\n\n", 7: rows[6][1]}


def test_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").limit(70)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_whole(rows)
    assert want != brute(rows)
    assert sorted((r.doc_id, r.n_lines, list(r.removed)) for r in op9_line_dedup(spark, str(tmp_path)).collect()) == want
