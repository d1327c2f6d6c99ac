"""The counting pass of the Katz model reads every block once."""
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from sward.llm import katz


def test_counting_unpacks_a_block_once(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(60)]
    tokens = np.concatenate([katz.token_arrays(pa.array([t]))[0] for t in texts])
    words, counts = np.unique(tokens, return_counts=True)
    table = np.sort(words[np.argsort(-counts)[:50]])
    box = SimpleNamespace(value={"w": table})
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array([True] * 60), pa.array(texts)],
                                       ["doc_id", "th", "train", "text"])
    items = [(p, r, x) for b in katz._blocks(1, box)([batch.slice(0, 30), batch.slice(30)])
             for p, r, x in zip(*(b.column(c).to_pylist() for c in ("part", "run", "block")))]
    seen, plain = [], katz._unpack
    monkeypatch.setattr(katz, "_unpack", lambda *a: seen.append(1) or plain(*a))
    rows = list(katz._count_pairs(box)(0, items))
    assert len(seen) == sum(x[:1] == b"P" for *_, x in items) > 0
    rare = np.concatenate([np.frombuffer(x, np.uint64) for _, n, x in rows if n is None])
    assert rare.tolist() == np.setdiff1d(words, table).tolist()
