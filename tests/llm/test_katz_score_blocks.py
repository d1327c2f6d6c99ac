"""What the pair partitions send of a document's score is little more than the score itself."""
import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sward.llm import katz


def test_score_blocks_are_small_and_whole():
    rng = random.Random(5)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(80)) for _ in range(70)] + ["w3", ""]
    train = [i % 7 != 2 for i in range(len(texts))]
    tokens = [t.split() + [None] for t in texts]
    counts = Counter(w for ws, of in zip(tokens, train) if of for w in ws)
    hashed = {w: katz.token_arrays(pa.array([w or ""]))[0][0] for ws in tokens for w in ws}
    n = [0, *(sum(c == r for c in counts.values()) for r in range(1, katz.KATZ_K + 2))]
    uni = katz.Unigrams(sum(counts.values()), len(counts), n)
    table = sorted((hashed[w], c) for w, c in counts.most_common(50))
    hot = {"w": np.array([w for w, _ in table], np.uint64), "ch": np.array([c for _, c in table] + [sum(train)]), "la": np.zeros(51)}
    box, parts = SimpleNamespace(value=hot), 6
    rare = [(hashed[w], c) for w, c in counts.items() if hashed[w] not in hot["w"]]
    assert rare
    sent = [np.array([x[i] for x in rare], np.uint64) for i in (0, 1)]
    ids = list(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(train), pa.array(texts)], ["doc_id", "th", "train", "text"])
    items = [x for b in katz._blocks(parts, box, uni)([batch]) for x in zip(*(b.column(c).to_pylist() for c in ("part", "run", "block")))]
    scored = [x for p in range(parts) for x in katz._score_pairs(box, 1, katz.good_turing([0] * 7), uni)(
        ([y for y in items if y[0] == p], [np.stack(sent).tobytes()]))]
    blocks = [b for _, b in scored if b[:1] == b"S"]
    entries = sum(len(katz._training_pairs([y for y in items if y[0] == p], hot["w"])[0]) > 0 for p in range(parts)) * len(texts)
    assert blocks and sum(map(len, blocks)) < 16 * entries  # 24 bytes before
    got = {r["doc_id"]: r for b in katz._documents([pa.RecordBatch.from_arrays(
        [pa.array([r for r, _ in scored]), pa.array([b for _, b in scored], pa.binary())], ["run", "block"])]) for r in b.to_pylist()}
    assert sorted(got) == ids
    for i, ws in enumerate(tokens):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(ws), sum(counts[w] > 0 for w in ws))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (uni.total + uni.distinct + 1)) for w in ws), rel=1e-12)


@pytest.mark.parametrize("x", [[], [0], [3, 255], [256, 0, 65_535], [1 << 16, 7], [1 << 32, 5]])
def test_small_numbers_come_back(x):
    assert katz._widened(katz._small(np.array(x, np.int64))).tolist() == x


def test_a_token_is_looked_up_once(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(60)) for _ in range(40)]
    tok = katz.token_arrays(pa.array(texts))[0]
    words, counts = np.unique(tok, return_counts=True)
    hot = {"w": words[::2], "ch": np.append(counts[::2], 40)}
    looked, plain = [], katz._lookup
    monkeypatch.setattr(katz, "_lookup", lambda keys, table: looked.append(len(keys)) or plain(keys, table))
    uni = katz.Unigrams(len(tok), len(words), [0, *(int((counts == r).sum()) for r in range(1, katz.KATZ_K + 2))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array([True] * 40), pa.array(texts)],
                                       ["doc_id", "th", "train", "text"])
    items = [x for b in katz._blocks(3, SimpleNamespace(value=hot), uni)([batch]) for x in zip(*(b.column(c).to_pylist() for c in ("part", "run", "block")))]
    assert sum(looked) == len(tok)  # more before: histories and words of distinct pairs again
    # a block holds histories and words as they were
    want = {(int(h), int(w)) for h, w in zip(katz.token_arrays(pa.array(texts))[1], tok)}
    got = set()
    for _, _, block in items:
        if block[:1] == b"P":
            h, w, *_ = katz._unpack(katz._loaded(block), hot["w"])
            got |= set(zip(h.tolist(), w.tolist()))
    assert got == want
