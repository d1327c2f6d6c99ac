import math
import random

from conftest import rows
from sward.operators.geo import path_lengths, ring_areas
from sward.operators.sequence import consecutive_pairs, row_sequence


def _skewed_vertices(spark, seed=7):
    rnd = random.Random(seed)
    data = []
    # one hot line with a third of all vertices, plus many short lines and single-vertex lines
    for s in range(600):
        data.append((0, s, 12 + rnd.random(), 48 + rnd.random()))
    for line in range(1, 400):
        for s in range(rnd.choice([1, 2, 3, 4])):
            data.append((line, s, 12 + rnd.random(), 48 + rnd.random()))
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "line_id long, s long, lon double, lat double")


def _by_line(data):
    lines = {}
    for line, s, lon, lat in data:
        lines.setdefault(line, []).append((s, lon, lat))
    return {k: sorted(v) for k, v in lines.items()}


def test_row_sequence_matches_sorted_order(spark):
    ids = [f"X{i:05d}" for i in random.Random(1).sample(range(100000), 3000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = dict(rows(row_sequence(df, ["id"], partitions=13), "id", "seq"))
    want = {i: n + 1 for n, i in enumerate(sorted(ids))}
    assert got == want


def test_pairs_with_hot_group_across_partitions(spark):
    data, df = _skewed_vertices(spark)
    got = sorted(rows(consecutive_pairs(df, "line_id", ["s"], ["s"], partitions=16),
                      "line_id", "p_s", "s"))
    want = sorted((line, a[0], b[0]) for line, v in _by_line(data).items() for a, b in zip(v, v[1:]))
    assert got == want


def _hav(a, b):
    (lon1, lat1), (lon2, lat2) = a, b
    r = math.radians
    h = math.sin(r(lat2 - lat1) / 2) ** 2 + math.cos(r(lat1)) * math.cos(r(lat2)) * math.sin(r(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_lengths_and_areas_match_brute_force(spark):
    data, df = _skewed_vertices(spark)
    lines = _by_line(data)
    km = dict(rows(path_lengths(df, "line_id", ["s"]), "line_id", "km"))
    want_km = {k: sum(_hav(a[1:], b[1:]) for a, b in zip(v, v[1:])) for k, v in lines.items() if len(v) > 1}
    assert set(km) == set(want_km)
    assert all(abs(km[k] - want_km[k]) < 1e-6 for k in km)

    km2 = dict(rows(ring_areas(df, "line_id", ["s"]), "line_id", "km2"))
    want = {}
    for k, v in lines.items():
        if len(v) >= 3:
            pts = [p[1:] for p in v]
            t = sum(math.radians(b[0] - a[0]) * (2 + math.sin(math.radians(a[1])) + math.sin(math.radians(b[1])))
                    for a, b in zip(pts, pts[1:] + pts[:1]))
            want[k] = abs(t) * 6371.0088 ** 2 / 2
    assert set(km2) == set(want)
    assert all(abs(km2[k] - want[k]) < 1e-6 * max(1.0, want[k]) for k in km2)


def test_distinct_inside_layout_shuffle(spark):
    data, df = _skewed_vertices(spark)
    dup = df.unionByName(df)
    a = sorted(rows(path_lengths(dup, "line_id", ["s"], distinct=True)))
    b = sorted(rows(path_lengths(df, "line_id", ["s"])))
    assert [x[0] for x in a] == [x[0] for x in b]
    assert all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b))


def test_row_sequence_with_payload_does_not_depend_on_exchange_reuse(spark):
    from pyspark.sql import functions as F
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(2_000_000).select(F.xxhash64("id").alias("k"), F.concat(F.lit("p"), "id").alias("payload"))
        n, low, high = (row_sequence(df, ["k"], partitions=16)
                        .agg(F.countDistinct("seq"), F.min("seq"), F.max("seq")).first())
        assert (n, low, high) == (2_000_000, 1, 2_000_000)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
