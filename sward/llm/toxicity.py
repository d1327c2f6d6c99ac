"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned: words that occur almost only in documents labelled toxic.
It is stored as a trie; the Levenshtein automata of all its terms are intersected
with the trie at once, as one automaton whose states are sets of (trie node, edits)
and which is determinised as words are read, so most words leave it after two or
three letters.  Every hit is then judged in its window of words: hits between
quotation marks and hits among words known from clean contexts count apart from
plain ones, and a logistic curve over these counts gives the score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.llm import common as C
from sward.llm.models import SAMPLE_DOCS, apply_logistic, fit_logistic, held_out, labelled_sample

#: A term needs this many toxic sample documents, this share of them, and this precision.
MIN_DOCS, MIN_SHARE, MIN_PRECISION = 3, 0.012, 0.9
MAX_TERMS = 2000
#: Terms of at least this many letters may differ by one edit.
FUZZY_FROM = 5
WINDOW = 5
THRESHOLD = 0.7
_OPEN, _CLOSE = "\"'“„«‘»", "\"'”“»’«"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¡¿"


def normal(word: str) -> str:
    """Lower case, without the marks at either end."""
    return word.lower().strip(_EDGE)


class Automaton:
    """Levenshtein automata of a lexicon's terms, intersected with its trie and determinised lazily."""

    def __init__(self, terms: dict[str, int]):
        """terms: largest edit distance allowed per term (0 or more)."""
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in sorted(terms):
            node = 0
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][ch]
            self.term[node] = t
        self.limit = terms
        self.most = max(terms.values(), default=0)
        self.alphabet = {ch for c in self.children for ch in c}
        # the edits a node may have used: the most that a term below it allows
        self.allow = [0] * len(self.children)
        for t in sorted(terms):
            node = 0
            self.allow[0] = max(self.allow[0], terms[t])
            for ch in t:
                node = self.children[node][ch]
                self.allow[node] = max(self.allow[node], terms[t])
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0}) if terms else -1

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state that holds these nodes (with edits), after skipping term letters; -1 if empty."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.allow[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= self.limit[self.term[n]]]
            self.accept.append(min(ends) if ends else None)
        return self.number[key]

    def _step(self, state: int, ch: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.states[state]:
            hit = self.children[node].get(ch)
            if hit is not None and nodes.get(hit, 99) > e:
                nodes[hit] = e
            if e + 1 <= self.allow[node] and nodes.get(node, 99) > e + 1:
                nodes[node] = e + 1
            for child in self.children[node].values():
                if e + 1 <= self.allow[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
        return self._state(nodes)

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within its limit, ties to the term that sorts first."""
        state = self.start
        for ch in word:
            if state < 0:
                return None
            if ch not in self.alphabet:
                ch = "\0"  # letters outside the lexicon all behave alike
            nxt = self.moves[state].get(ch)
            if nxt is None:
                nxt = self.moves[state][ch] = self._step(state, ch)
            state = nxt
        return self.accept[state] if state >= 0 else None


def learn_lexicon(texts: list[tuple[int, str]]) -> dict[str, int]:
    """Terms and their allowed edits from (label, text) pairs; equal texts count once."""
    toxic, clean, n = Counter(), Counter(), 0
    for lab, text in dict.fromkeys(texts):
        words = {normal(w) for w in set(text.split())}
        n += lab
        (toxic if lab else clean).update(words)
    need = max(MIN_DOCS, MIN_SHARE * n)
    good = [(c, w) for w, c in toxic.items() if len(w) > 2 and c >= need and c / (c + clean[w]) >= MIN_PRECISION]
    best = sorted(good, key=lambda x: (-x[0], x[1]))[:MAX_TERMS]
    return {w: int(len(w) >= FUZZY_FROM) for _, w in best}


def hits(words: list[str], found: dict[str, tuple[int, str]]):
    """(place, edits, quoted, window words) of every hit in a text's words."""
    out = []
    for i, w in enumerate(words):
        hit = found.get(w)
        if hit is None:
            continue
        lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        quoted = (any(words[j][0] in _OPEN for j in range(lo, i + 1))
                  and any(words[j].rstrip(".,;:!?")[-1:] in _CLOSE and words[j].rstrip(".,;:!?")[-1:] for j in range(i, hi)))
        context = [normal(words[j]) for j in range(lo, hi) if words[j] not in found]
        out.append((i, hit[0], quoted, context))
    return out


def find(texts: list[list[str]], automaton: Automaton, known: dict) -> dict[str, tuple[int, str]]:
    """Hits among the distinct words of some texts.  ``known`` remembers words between calls (bounded)."""
    if len(known) > 400_000:
        known.clear()
    seen = set()
    for words in texts:
        seen.update(words)
    out = {}
    for w in seen:
        hit = known.get(w, 0)
        if hit == 0:
            hit = known[w] = automaton.match(normal(w))
        if hit is not None:
            out[w] = hit
    return out


N_FEATURES = 5


def features(words: list[str], found: dict, context: dict[str, float]) -> list[float]:
    """Plain exact hits, plain misspelled hits, quoted hits (log counts), hits per 100 words, window score."""
    exact = near = quoted = 0
    window = 0.0
    for _, edits, q, around in hits(words, found):
        if q:
            quoted += 1
        elif edits:
            near += 1
        else:
            exact += 1
        known = [context[w] for w in around if w in context]
        window += sum(known) / (len(known) + 3)
    n = exact + near + quoted
    return [math.log1p(exact), math.log1p(near), math.log1p(quoted), min(10.0, 100 * (exact + near) / max(1, len(words))),
            window / n if n else 0.0]


def fit(texts: list[tuple[int, str]]) -> dict:
    """Lexicon, window words and curve from (label, text) pairs."""
    terms = learn_lexicon(texts)
    automaton = Automaton(terms)
    split = [t.split() for _, t in texts]
    label = np.array([lab for lab, _ in texts], dtype=np.float64)
    found = find(split, automaton, {})
    near, far = Counter(), Counter()
    for words, lab in zip(split, label):
        if found.keys().isdisjoint(words):
            continue
        for _, _, _, around in hits(words, found):
            (near if lab else far).update(set(around))
    context = {}
    if far:  # windows are told apart only where clean documents hold hits, too
        a, b = sum(near.values()), sum(far.values())
        for w in set(near) | set(far):
            if near[w] + far[w] >= 5:
                context[w] = math.log((near[w] + 1) / (a + 2)) - math.log((far[w] + 1) / (b + 2))
    x = np.array([features(w, found, context) if not found.keys().isdisjoint(w) else [0.0] * N_FEATURES for w in split])
    return {"terms": terms, "context": context, "curve": fit_logistic(x, label, l2=0.3)}


def train(docs: DataFrame, labels: DataFrame, limit: int) -> dict:
    """Model from at most ``limit`` labelled documents; {"share": ...} when there is nothing to tell apart."""
    rows = labelled_sample(docs, labels, "toxic", limit).select("doc_id", "label", "text")
    rows = sorted((r["doc_id"], r["label"], r["text"]) for r in rows.toLocalIterator())  # bounded by limit
    texts = [(lab, t) for _, lab, t in rows]
    share = sum(lab for lab, _ in texts) / len(texts) if texts else 0.0
    if share in (0.0, 1.0):
        return {"share": share}
    return fit(texts)


def _scorer(box):
    def run(batches):
        model = box.value
        automaton = Automaton(model.get("terms", {}))
        known: dict = {}
        for b in C.slices(batches, rows=1024, data_bytes=3 << 20):
            if "share" in model:
                p = np.full(b.num_rows, model["share"])
            else:
                words = [t.split() if t else [] for t in b.column("text").to_pylist()]
                found = find(words, automaton, known)
                keys = found.keys()
                x = np.zeros((b.num_rows, N_FEATURES))
                for i, w in enumerate(words):
                    if not keys.isdisjoint(w):
                        x[i] = features(w, found, model["context"])
                p = apply_logistic(model["curve"], x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64())],
                                             ["doc_id", "score"])
    return run


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) for every row of ``docs`` (doc_id, text).

    labels: (doc_id, toxic); rows whose crc32(doc_id) modulo 3 is 1 are never learned
    from.  A text without hits, NULL and empty ones included, gets the curve's value
    at zero hits.  Without labels of both kinds every text scores the share of toxic
    ones (0 without any).  Repeated rows score alike; a NULL doc_id counts as not held
    out.  Other columns are ignored.
    """
    box = spark.sparkContext.broadcast(train(docs, labels, limit))
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(box), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
