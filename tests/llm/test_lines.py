from resultloom.llm.lines import clean_lines, dedup_lines

TESTDATA = "/root/testdata/sf0.001"


def close(a, b):
    """Within one edit, from the definition."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least=15):
    seen, out = [], []
    for i, text in sorted(rows):
        removed = []
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if len(line) >= least:
                if any(close(line, s) for s in seen):
                    removed.append(n)
                seen.append(line)
        out.append((i, len(text.split("\n")) if text else 0, removed))
    return sorted(out)


def found(docs):
    return sorted((r.doc_id, r.n_lines, list(r.removed)) for r in dedup_lines(docs).collect())


def test_planted_lines(spark):
    base = "the quick brown fox jumps over the läzy dog"
    variants = [base, base[:-1], base + "x", "T" + base[1:], base.replace("läzy", "lazy"), base.replace("fox", "fax"), base.replace("fox", "fx"),
                base.replace("quick", "quiick"), base.replace("jumps", "jimpz"), "x" + base, "  " + base + "\r", base[1:]]
    rows = [(i, f"short\n{v}\n\n{v} tail {i} and {i * 7919}") for i, v in enumerate(variants)]
    rows += [(20, base + "\n" + base), (21, None), (22, ""), (23, "\n\n"), (24, "a line ends here\n"), (25, "a line ends herf"),
             (30, " ".join(["long"] * 20000)), (31, " ".join(["long"] * 20000)[:-1]), (32, "aaaaaaaaaaaaaaaaaaaa"), (33, "aaaaaaaaaaaaaaaaaaa")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, hash string")
    want = brute(rows)
    assert sum(len(r[2]) for r in want) > 8
    assert found(docs) == want
    cleaned = clean_lines(docs.withColumn("removed", docs.hash))
    assert cleaned.columns == ["doc_id", "text", "hash", "removed"]
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert 20 not in texts and texts[21] is None and texts[22] == "" and texts[23] == "\n\n"
    assert texts[24] == "a line ends here\n" and texts[1] == f"short\n\n{variants[1]} tail 1 and 7919"


def test_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").limit(80)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs) == brute(rows)


def test_odd_tables(spark):
    line = "one line that is long enough"
    docs = spark.createDataFrame([(None, line), (1, line), (1, line), (1, line + "s")], "doc_id long, text string")
    got = found(docs.filter("doc_id is not null"))
    assert [r[2] for r in got].count([]) in (1, 2) and len(got) == 3
    assert {(r.doc_id, tuple(r.removed)) for r in dedup_lines(docs).filter("doc_id is null").collect()} == {(None, (0,))}
    assert dedup_lines(docs.limit(0)).collect() == []
