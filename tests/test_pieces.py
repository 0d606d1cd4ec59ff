import pyarrow as pa

from lodeseam.operators import substring


def test_a_batch_of_long_texts_goes_in_pieces(monkeypatch):
    monkeypatch.setattr(substring, "STEP", 10)
    texts = ["a" * 4, None, "b" * 25, "", "c", "d" * 9, "é" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = [p.column(1).to_pylist() for p in substring.pieces(batch, 1)]
    assert sum(got, []) == texts and all(sum(len(t or "") for t in p[1:]) <= 10 for p in got) and len(got) > 2
    assert list(substring.pieces(batch.slice(0, 0), 1)) == []
