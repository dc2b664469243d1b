import pyarrow as pa

from gleanery.llm import batches


def test_portions_keep_rows_whole_and_in_order():
    texts = ["a" * 5, None, "", "b" * 30, "é" * 4, "c", "d" * 9]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": texts})
    got = list(batches.portions([batch, batch.slice(0, 0)], limit=10))
    assert [t for _, part in got for t in part] == texts
    assert [x for part, _ in got for x in part.column(0).to_pylist()] == list(range(7))
    assert all(sum(len((t or "").encode()) for t in part) <= 10 or len(part) == 1 for _, part in got)
