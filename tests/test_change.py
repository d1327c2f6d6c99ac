import itertools


from conftest import rows
from sward.operators.change import change_classes

N, F6510, F6210 = "non-FFH", "6510", "6210"
YEARS = (2017, 2018, 2019)


def classify(spark, triples):
    data = []
    for i, t in enumerate(triples):
        for y, v in zip(YEARS, t):
            if v is not ...:
                data.append((f"p{i:02d}", y, v))
    df = spark.createDataFrame(data, "plot string, surveyYear int, ffh string")
    got = dict(rows(change_classes(df, YEARS), "plot", "changeType"))
    return [got.get(f"p{i:02d}") for i in range(len(triples))]


def expected(t):
    a, b, c = (x != N for x in t)   # True = FFH
    if not a and b and c:
        return "better"
    if (a and not b and c) or (not a and b and not c) or (not a and not b and c) or (a and b and not c):
        return "change"
    if not a and not b and not c:
        return "non-FFH"
    if t == (F6510,) * 3:
        return "FFH6510"
    if t == (F6210,) * 3:
        return "FFH6210"
    if a and b and c:
        return "any-FFH"
    return "worse"


def test_all_triples(spark):
    triples = list(itertools.product([N, F6510, F6210], repeat=3))
    got = classify(spark, triples)
    assert got == [expected(t) for t in triples]
    # the only "worse" pattern is FFH, non, non
    assert [t for t, g in zip(triples, got) if g == "worse"] == [(F6510, N, N), (F6210, N, N)]


def test_missing_years(spark):
    triples = [(..., F6510, F6510), (N, ..., F6510), (F6510, F6510, ...), (N, F6510, ...)]
    got = classify(spark, triples)
    # better needs x17 = non and x18, x19 != non: NULL x18 makes the first test NULL -> NULL
    assert got == [None, None, None, None]
