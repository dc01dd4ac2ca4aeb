import pyarrow as pa

from lodestack.llm.batches import sliced


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["aaa", None, "", "b" * 50, "cc", "dddd", "e"]})
    parts = list(sliced([batch, batch.slice(0, 0), batch.slice(3)], "t", 6))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(7), *range(3, 7)]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 6 for p in parts)
