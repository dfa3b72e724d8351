"""Records of a batch go out in bounded parts, and a task gives memory back when it ends."""

import pyarrow as pa

from chronofold.llm import shared, substring_dedup


class Rows:
    """Stands in for a DataFrame and keeps the function that would run in its tasks."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_records_leave_in_parts_and_memory_goes_back(monkeypatch):
    freed = []
    monkeypatch.setattr(shared, "give_back", lambda: freed.append(1))
    run = substring_dedup.records(Rows())
    n = 1200
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(["ab" * 200] * n), pa.array([[(10 << 16 | 5 << 8) << 1]] * n, pa.list_(pa.int64()))],
        names=["id1", "id2", "text", "spots"])
    parts = list(run(iter([batch])))
    assert [p.num_rows for p in parts] == [500, 500, 200] and freed == [1]
    assert pa.Table.from_batches(parts).column("id1").to_pylist() == list(range(n))
