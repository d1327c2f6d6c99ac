"""What packing keeps in a worker that does other work afterwards."""
import gc
import weakref

import pyarrow as pa

from sward.llm import common as C, packing as P
from sward.llm.queries import tokenizer_path


def test_tokenizer_stays_and_chunks_go(monkeypatch):
    texts = [" ".join(f"word{i * j % 97} mark{i}." for j in range(i % 30)) for i in range(700)] + [None, ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]
    monkeypatch.setattr(P, "_STATE", [])
    rows = [r for b in P._pack_rows(tokenizer_path(), 512, 128, 100)(iter(batches)) for r in b.to_pylist()]
    assert len(P._STATE[2]) > 100
    monkeypatch.setattr(P, "_STATE", [])
    sizes, encode = [], P._encode
    monkeypatch.setattr(P, "_encode", lambda texts, *a: sizes.append(len(texts)) or encode(texts, *a))
    monkeypatch.setattr(P, "TASK_ENTRIES", 50)
    kept = []
    for _ in range(2):
        run = P._pack_rows(tokenizer_path(), 512, 128, 100, keep_cache=False)
        assert [r for b in run(iter(batches)) for r in b.to_pylist()] == rows
        assert P._STATE and not P._STATE[2]
        kept.append(P._STATE[1])
    assert kept[0] is kept[1]
    assert sum(sizes) == 2 * len(texts) and max(sizes) <= P.TASK_TEXTS


def test_release_collects():
    class Ring:
        pass
    ring = Ring()
    ring.itself, gone = ring, weakref.ref(ring)
    gc.disable()
    try:
        del ring
        C.release_memory()
        assert gone() is None
    finally:
        gc.enable()
