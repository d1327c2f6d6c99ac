"""Training sees every line of a sampled document."""
import numpy as np
import pyarrow as pa


def test_sample_keeps_late_lines():
    from sward.llm.quality import _sample_rows
    text = "\n".join(f"line {i} of a long text" for i in range(1000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.array([text])], ["doc_id", "label", "text"])
    (row,) = _sample_rows(iter([batch]))
    assert len(row.column("size")[0].as_py()) // 4 == 1000


def test_slices_do_not_change_scores(spark, monkeypatch):
    """Batches cut at any size give each text the same score up to rounding of matrix products; a worker's memory is given back behind the last row."""
    from sward.llm import common as C, quality as Q
    rng = np.random.default_rng(5)
    texts = ["\n".join(" ".join(rng.choice(["word", "12", "Ab!", "lorem,"], 1 + rng.integers(6))) for _ in range(rng.integers(1, 9)))
             for _ in range(60)] + [None, "", " \n "]
    x, size, off = Q.line_features(pa.array(texts))
    model = Q.fit(x, off, size.astype(float), (np.arange(len(texts)) % 2))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    freed = []
    monkeypatch.setattr(C, "release_memory", lambda: freed.append(1))
    got = []
    for size_limit in (1, 100, 1 << 20):
        monkeypatch.setattr(Q, "SLICE_BYTES", size_limit)
        got.append([s for b in C.releasing(Q._scorer(model))(iter([batch])) for s in b.column("score").to_pylist()])
    assert len(got[0]) == len(texts)
    assert np.allclose(got[0], got[2], rtol=0, atol=1e-12) and np.allclose(got[1], got[2], rtol=0, atol=1e-12), np.abs(np.subtract(got[0], got[2])).max()
    assert len(freed) == 3
