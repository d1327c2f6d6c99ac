"""Language prediction against plain sets of n-grams: every n-gram of the sample counts, and tables may be split."""
import random
import zlib

import pytest
from pyspark.sql import functions as F


def gram_list(text):
    """Each window of four that has a letter in its second place; other places are blanks."""
    low = "  " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text) + "   "
    return [low[i - 1:i + 3] for i in range(1, len(low) - 2) if low[i] != " "]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    stems = {f"l{k:02d}": ["".join(rng.choice("abcdefghijkäöжд") for _ in range(rng.randrange(3, 8))) for _ in range(12)] for k in range(20)}
    common = ["lorem", "ipsum", "dolor"]  # every language has some n-grams of the others
    rows = []
    for d in range(400):
        lang = f"l{rng.randrange(20):02d}"
        rows.append((d, " ".join(rng.choice(stems[lang] + common) for _ in range(rng.randrange(1, 15))), lang))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_gram_counts(spark, corpus):
    from sward.llm.langid import predict_language
    rows, df = corpus
    known = {}
    for d, t, x in rows:
        if zlib.crc32(str(d).encode()) % 3 != 1:
            known.setdefault(x, set()).update(gram_list(t))
    for r in predict_language(spark, df).join(df.select("doc_id", "text"), "doc_id").collect():
        count = {x: sum(g in s for g in gram_list(r["text"])) for x, s in known.items()}
        best = max(count.values())
        assert count[r["lang_pred"]] >= best - 0.05 and r["score"] == pytest.approx(best / sum(count.values()), abs=2e-3)


def test_split_tables_agree(spark, corpus):
    """20 languages in three tables (8 to a byte of a 64 KB filter) give what one table gives, odd texts included."""
    from sward.llm.langid import predict_language, train
    _, df = corpus
    df = df.unionByName(spark.createDataFrame([(900, None, "l01"), (901, "", None), (902, "!! 12", "l02"), (None, "lorem", None), (903, "ъъъъъ", None)], df.schema))
    assert [len(t["langs"]) for t in train(df, table_bytes=1 << 16)[0]] == [8, 8, 4]
    key = ["doc_id", "held_out", "lang_pred", F.round("score", 9).alias("score")]
    one = sorted(map(str, predict_language(spark, df).select(*key).collect()))
    assert one == sorted(map(str, predict_language(spark, df, table_bytes=1 << 16).select(*key).collect()))
    assert sum("'und'" in x for x in one) == 3
