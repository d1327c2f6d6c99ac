"""Short benchmark items: every alignment that the rule accepts leaves a seed."""
import itertools
import math

from sward.llm.decontam import MIN_MATCH, leaks


def test_every_accepted_substitution_of_short_items(spark):
    docs, items, want = [], [], set()
    for n in (1, 4, 5, 8, 9, 10, 11, 12, 13):
        item = [f"i{n}t{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        for k in range(n - math.ceil(n * MIN_MATCH) + 1):
            for at in itertools.combinations(range(n), k):
                d = len(docs)
                docs.append((d, " ".join(["x", "y"] + [f"s{d}" if j in at else w for j, w in enumerate(item)] + ["z"])))
                want.add((d, n))
        docs.append((len(docs), " ".join(["s"] * 3 + item[3:])))  # too far from an item of 13 tokens or fewer
        if n <= 4:
            docs.pop()
    for rows in (500_000, 0):
        got = leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"),
                    spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=rows)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_rows_of_one_id_with_different_texts(spark):
    """Shuffled seeds give what broadcast seeds give, each row and item with its own tokens."""
    item = " ".join(f"b{i}" for i in range(16))
    docs = [(1, " ".join(f"f{i}" for i in range(50)) + " " + item), (1, "short"), (2, "short"), (2, item)]
    items = [(7, item), (7, "another text of the same item that is nowhere in the documents")]
    got = [sorted(map(tuple, leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=n).collect()))
           for n in (500_000, 0)]
    assert got[0] == got[1] == [(1, 7, 50, 0, 16, 16, 13), (2, 7, 0, 0, 16, 16, 13)]
