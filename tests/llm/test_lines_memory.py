import tracemalloc

import numpy as np
import pyarrow as pa

from resultloom.llm.lines import _cut, _scan, _scan_keys


def batch_of(texts):
    return pa.record_batch([pa.array(texts), pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64())], names=["text", "doc_key", "text_key"])


def test_lines_are_cut_in_pieces_that_hold_little_memory():
    words = np.random.default_rng(1).integers(0, 10**9, (4096, 100))
    texts = ["\n".join(" ".join(map(str, row[k : k + 10])) for k in range(0, 100, 10)) for row in words]
    batch = batch_of(texts)
    for run in (_scan(1), _scan_keys(15, 8)):
        tracemalloc.start()
        rows = sum(out.num_rows for out in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 64 << 20


def test_a_piece_has_one_row_of_keys_a_bucket():
    texts = ["\n".join(f"line {k} of text {d} with words" for k in range(30)) for d in range(100)]
    out = [row for batch in _scan_keys(15, 8)([batch_of(texts)]) for row in batch.to_pylist()]
    assert sorted(row["bucket"] for row in out) == list(range(8))
    assert sum(len(row["parts"]) for row in out) == 100 * 30 * 8
    assert all(len(row["keys"]) == len(row["hashes"]) == 8 * len(row["parts"]) for row in out)


def test_texts_are_cut_a_few_at_a_time():
    texts = ["a\n" + "b" * (1 << 20), None, "c\nd"] * 4
    batch = pa.record_batch([pa.array([[0], [], [1]] * 4, pa.list_(pa.int64())), pa.array(texts)], names=["removed", "text"])
    out = list(_cut([batch]))
    assert len(out) > 1
    assert [t for b in out for t in b.column("text").to_pylist()] == ["b" * (1 << 20), None, "c"] * 4
