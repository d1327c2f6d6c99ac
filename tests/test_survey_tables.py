"""Survey tables as the reference has them: wide sheets, matrices, files of several shapes, geometry, stored tables."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows


def leaf_files(df):
    """Files that the scan of an executed DataFrame read (the scan's own metric)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec":
            out.append((p.relation().toString(), p.metrics().get("numFiles").get().value()))
        else:
            it = p.children().iterator()
            while it.hasNext():
                todo.append(it.next())
    return out


# ------------------------------------------------------------------ matrix
def test_matrix_round_trip(spark, tmp_path):
    from sward.sources.matrix import read_matrix, write_matrix
    data = [(s, f"sp {r}", f"X{s}_{v}", (r * v % 7) / 4 or None) for s in (1, 2) for r in range(40) for v in range(5 + 300 * (s - 1))]
    data += [(1, 'odd, "name"', "X1_0", 2.5), (1, "", "X1_1", 1e-5)]
    df = spark.createDataFrame(data, "sheet int, name string, id string, n double")
    path = write_matrix(df, str(tmp_path / "m"))
    want = sorted(r[1:] for r in data if r[3] is not None)
    assert sorted(rows(read_matrix(spark, path), "name", "id", "n")) == want
    some = spark.createDataFrame([("X1_0",), ("X2_300",)], "id string")
    assert sorted(rows(read_matrix(spark, path, visits=some), "name", "id", "n")) == [w for w in want if w[1] in ("X1_0", "X2_300")]
    with pytest.raises(ValueError, match="X9"):
        read_matrix(spark, path, visits=spark.createDataFrame([("X9",), ("X1_0",)], "id string"))


def test_matrix_of_ten_thousand_columns(spark, tmp_path):
    from sward.sources.matrix import read_matrix
    n = 10_000
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.csv").write_text("name;" + ";".join(f"v{i}" for i in range(n)) + "\n"
                                          + "\n".join(f'"s{r}";' + ";".join("0,5" if i % 1000 == r else "NA" if i % 3 else "" for i in range(n)) for r in range(20)) + "\n")
    (tmp_path / "w" / "b.csv").write_text('name;"v1";w0\ns1;7;x\ns2;;1,25\n')
    got = read_matrix(spark, str(tmp_path / "w"), sep=";", dec=",")
    want = [(f"s{r}", f"v{i}", 0.5) for r in range(20) for i in range(n) if i % 1000 == r] + [("s1", "v1", 7.0), ("s2", "w0", 1.25)]
    assert sorted(rows(got, "name", "id", "n")) == sorted(want)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000  # no expression for each column


# ------------------------------------------------------------------ E1 over the survey's own tables
def raw_tables(spark):
    rng = random.Random(9)
    sheet, cover = [], []
    years = (2017, 2018, 2019)
    for p in range(1, 13):
        row = {"id": f"{p:02d}_m", "block": "b", "location": ["Plattling", "Metten"][p % 2], "side": "land", "exposition": "south",
               "constructionYear": 2000 + p % 3, "riverkm": 2300.0 + p, "distanceRiver": 120.35}
        for y in years:
            row |= {f"vegetationCov_{y}": str(50 + p) if p != 3 else "bad", f"botanist_{y}": f"B{y}" if y != 2018 else None}
        sheet.append(row)
        for y in years:
            for s in range(25):
                if p != 5 and rng.random() < 0.7:
                    cover.append((f"X{p:02d}_m_{y}", f"sp{s}", rng.choice([0.5, 1.0, 2.0, 5.0])))
    traits = [{"name": f"sp{s}", "family": ["Poaceae", "Fabaceae", None][s % 3], "sociology": 5400.0 + s, "targetHerb": ["yes", "no"][s % 2],
               "targetGrass": "no", "targetArrhenatherion": ["yes", "no"][s % 5 > 0], "nitrogenIndicator": "no", "ruderalIndicator": "no",
               "ffh6510": "yes", "ffh6210": "no", "rlg": "3" if s == 4 else None, "rlb": None, "table30": None,
               "table33": ["2", "3", None][s % 3], "table34": None} for s in range(25)]
    schema = "name string, family string, sociology double, targetHerb string, targetGrass string, targetArrhenatherion string, " \
             "nitrogenIndicator string, ruderalIndicator string, ffh6510 string, ffh6210 string, rlg string, rlb string, table30 string, " \
             "table33 string, table34 string"
    numbers = ("constructionYear", "riverkm", "distanceRiver")
    sheet_schema = ", ".join(f"{c} {'int' if c == numbers[0] else 'double' if c in numbers else 'string'}" for c in sheet[0])
    return (spark.createDataFrame([tuple(r.values()) for r in sheet], sheet_schema), cover,
            spark.createDataFrame([tuple(t.values()) for t in traits], schema), traits)


def test_pipeline_on_raw_tables(spark, tmp_path):
    from sward.plans import pipeline as P
    from sward.sources.matrix import read_matrix, write_matrix
    sheet, cover, traits, trait_rows = raw_tables(spark)
    long = spark.createDataFrame(cover, "id string, name string, n double").withColumn("sheet", F.substring("id", -4, 4).cast("int"))
    long = read_matrix(spark, write_matrix(long, str(tmp_path / "m")))
    table = P.finish(P.build_sites(sheet, long, traits), (*P.SITE_COLUMNS, "changeType", "vegetationCov"))
    got = {r["id"]: r for r in table.collect()}
    assert table.columns[:17] == list(P.SITE_COLUMNS)
    family = {t["name"]: t["family"] for t in trait_rows}
    want = {}
    for i, s, n in cover:
        want.setdefault(i, []).append((s, n))
    assert set(got) == {i for i, c in want.items() if sum(n for s, n in c if family[s]) > 0}
    for i, c in want.items():
        r = got[i]
        assert r["speciesRichness"] == len(c) and abs(r["accumulatedCov"] - sum(n for s, n in c if family[s])) < 0.06
        assert r["rlgRichness"] == sum(s == "sp4" for s, _ in c)
        assert (r["plot"], r["surveyYear"], r["distanceRiver"]) == (i[1:3], int(i[-4:]), 120.3)
        assert r["locationYear"] == ("PLA" if int(i[1:3]) % 2 == 0 else "MET") + f"-{2000 + int(i[1:3]) % 3}"
        assert r["vegetationCov"] == (None if i[1:3] == "03" else 50.0 + int(i[1:3]))
    states = {}
    for r in got.values():
        states.setdefault(r["plot"], {})[r["surveyYear"]] = "N" if r["ffh"] == "non-FFH" else "F"
    for r in got.values():
        s = states[r["plot"]]
        if len(s) == 3 and "".join(s[y] for y in (2017, 2018, 2019)) == "NFF":
            assert r["changeType"] == "better"


def test_measures_without_columns(spark):
    from sward.operators.reshape import wide_to_visits
    df = spark.createDataFrame([("a", "1", "2", "x")], "plot string, m_2017 string, m_2019 string, b_2017 string")
    assert sorted(rows(wide_to_visits(df, ["plot"], ["m", "b"], numeric=["m"]))) == [("a", 2017, 1.0, "x"), ("a", 2019, 2.0, None)]
    with pytest.raises(ValueError, match="height"):
        wide_to_visits(df, ["plot"], ["m", "height"])


# ------------------------------------------------------------------ J5, C22
def test_change_type_on_site_rows_needs_one_exchange_of_the_plot(spark):
    from sward.plans import pipeline as P
    plan = P.finish(P.sites(spark, SF_SMALL), (*P.SITE_COLUMNS, "changeType"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") - plan.count("ReadSchema: struct<s_") - plan.count("ReadSchema: struct<n_") \
        - plan.count("ReadSchema: struct<r_") - plan.count("ReadSchema: struct<p_") <= 1
    # the window runs on the exchange that joins the plots: visits on one side, site attributes on the other
    assert plan.count("hashpartitioning(plot") == 3  # with the one of the visit aggregate
    assert "hashpartitioning(plot#" not in plan
    assert "Window" not in P.site_table(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_change_paths(spark):
    from sward.operators.change import change_paths
    n = "non-FFH"
    plots = {"a": [n, n, "6510", "6510"], "b": ["6510", "6510", n, n], "c": [n, "6510", n, "6210"], "d": [n] * 4, "e": ["6510"] * 4,
             "f": ["6510", "6210", "6510", "6510"], "g": [n, None, "6510", "6510"], "h": [n, n, n, "6510"]}
    data = [(p, 2017 + i, v) for p, vs in plots.items() for i, v in enumerate(vs) if v]
    got = {r["plot"]: tuple(r)[1:] for r in change_paths(spark.createDataFrame(data, "plot string, surveyYear int, ffh string")).collect()}
    assert got == {"a": ("NNFF", 4, 1, 0, "better"), "b": ("FFNN", 4, 0, 1, "worse"), "c": ("NFNF", 4, 2, 1, "change"),
                   "d": ("NNNN", 4, 0, 0, n), "e": ("FFFF", 4, 0, 0, "FFH6510"), "f": ("FFFF", 4, 0, 0, "any-FFH"),
                   "g": ("N-FF", 3, 1, 0, None), "h": ("NNNF", 4, 1, 0, "change")}


def test_path_rules_equal_the_three_year_rules(spark):
    import itertools

    from sward.operators.change import change_classes, change_paths
    triples = list(itertools.product(["non-FFH", "6510", "6210"], repeat=3))
    df = spark.createDataFrame([(f"p{i}", 2017 + y, v) for i, t in enumerate(triples) for y, v in enumerate(t)],
                               "plot string, surveyYear int, ffh string")
    a = dict(rows(change_paths(df), "plot", "pathType"))
    assert a == dict(rows(change_classes(df, (2017, 2018, 2019)), "plot", "changeType"))


# ------------------------------------------------------------------ geometry
def test_line_pieces(spark):
    from sward.operators.geo import line_pieces
    rng = random.Random(1)
    size = {(1, 0): 500, (1, 1): 1, (2, 0): 7, (3, 0): 8, (3, 2): 2, (4, 0): 13}  # line 1 is hot
    data = [(li, p, i, 12 + rng.randrange(1000) / 1000, 48 + rng.randrange(1000) / 1000) for (li, p), n in size.items() for i in range(n)]
    df = spark.createDataFrame(data + data[:50], "line_id int, part int, seq int, lon double, lat double").repartition(6)
    got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in line_pieces(df, "line_id", "part", ["seq"], piece=6, distinct=True).collect()}
    want = {}
    for (li, p), n in size.items():
        xy = [f"{d[3]:.6f} {d[4]:.6f}" for d in data if d[:2] == (li, p)]
        for k in range(max(1, -(-(n - 1) // 6))):
            part = xy[6 * k:6 * k + 7]
            want[(li, p, k)] = (len(part), ("LINESTRING (" if len(part) > 1 else "POINT (") + ", ".join(part) + ")")
    assert got == want


# ------------------------------------------------------------------ stored table
@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from sward.plans.stored import write_stored
    data = [(f"{p:05d}", y, "Metten", p % 13, p % 9, 5, "G213") for p in range(400) for y in (2019, 2017, 2018)]
    df = spark.createDataFrame(data, "plot string, surveyYear int, location string, speciesRichness int, biotopePoints int, "
                                     "rlgRichness int, biotopeType string")
    return write_stored(df, str(tmp_path_factory.mktemp("stored") / "t"), buckets=16)


def test_stored_selection_reads_fewer_files(spark, stored):
    from sward.plans.stored import read_stored, stored_series
    files = len(read_stored(spark, stored).inputFiles())
    assert files == 16
    got = stored_series(spark, stored, "speciesRichness", ["00007", "00011", "00007", None])
    assert [(r["plot"], r["surveyYear"], r["y"], r["seq"]) for r in got.collect()] == \
        [(p, y, int(p) % 13, i + 1) for p in ("00007", "00011") for i, y in enumerate((2017, 2018, 2019))]
    assert all(n <= 2 for _, n in leaf_files(got))
    for nothing in (None, [], [None], ["99999"]):
        assert stored_series(spark, stored, "speciesRichness", nothing).collect() == []


def test_stored_selection_by_table_prunes_at_run_time(spark, stored, tmp_path):
    from sward.plans.stored import stored_series
    spark.createDataFrame([(f"{p:05d}", p) for p in range(400)], "plot string, k int").write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids")).where("k = 33").select("plot")
    got = stored_series(spark, stored, "biotopePoints", ids)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert [r["surveyYear"] for r in got.collect()] == [2017, 2018, 2019]
    assert any(n == 1 for rel, n in leaf_files(got))
    assert stored_series(spark, stored, "biotopePoints", ids.where("plot = 'none'")).collect() == []


def test_year_domain_and_unique_markers(spark):
    from sward.operators.mapview import one_row_per_plot, plot_series
    df = spark.createDataFrame([("a", "01", 2017, 60, "x"), ("a", "01", 2030, 5, "x")], "location string, plot string, surveyYear int, "
                               "speciesRichness int, biotopeType string")
    got = plot_series(df, "speciesRichness", ["01"], ordered=True, domain=(2016, 2020))
    assert rows(got, "seq", "in_range") == [(1, False), (2, False)]
    assert rows(plot_series(df, "speciesRichness", ["01"]), "in_range") == [(False,), (True,)]
    with pytest.raises(Exception, match="more than one marker for plot 01"):
        one_row_per_plot(df).collect()
    assert one_row_per_plot(df.where("surveyYear = 2017")).count() == 1


# ------------------------------------------------------------------ delimited files
def test_mixed_headers_skip_and_empty_text(spark, tmp_path):
    from sward.sources.csv import APP_NA, read_typed_csv
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "1.csv").write_text('a,b\n1,x\n2,\n3,""\n4,na\n5\n')
    (d / "2.csv").write_text('b,a,c\ny,6,"q, r"\nNA,7,\n')
    types = {"a": "int", "b": "string"}
    got = sorted(rows(read_typed_csv(spark, str(d), types, tokens=APP_NA), "a", "b", "c"))
    assert got == [(1, "x", None), (2, "", None), (3, "", None), (4, None, None), (5, None, None), (6, "y", "q, r"), (7, None, "")]
    got = sorted(rows(read_typed_csv(spark, str(d), types), "a", "b", "c"))
    assert got[1] == (2, None, None) and got[6] == (7, None, None)
    with pytest.raises(Exception):
        read_typed_csv(spark, str(d), types, uniform=True).collect()
    with pytest.raises(ValueError, match="zz"):
        read_typed_csv(spark, str(d), {"zz": "int"})
    s = tmp_path / "skip"
    s.mkdir()
    (s / "1.csv").write_text("note\nanother,note\nk;v\n1;0,5\nk;v\n\n2;x\n")
    (s / "2.csv").write_text("n\nn\nv;k\n1,25;3\n")
    got = sorted(rows(read_typed_csv(spark, str(s), {"k": "int", "v": "double"}, sep=";", dec=",", skip=2), "k", "v"), key=str)
    assert got == sorted([(1, 0.5), (None, None), (2, None), (3, 1.25)], key=str)  # a second header line is data here


# ------------------------------------------------------------------ factors, vectors, sorted tables
def test_factor_codes_follow_the_files(spark, tmp_path):
    from sward.operators.factors import factor_levels, with_position
    values = ["m", "b", None, "z", "b", "a", "m", "c"] * 50
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(values)], "i int, v string, w int").coalesce(1)
    df.write.parquet(str(tmp_path / "t"))
    for n in ("2", "9"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = rows(factor_levels(with_position(spark, str(tmp_path / "t"), ["v", "w"]), ["v", "w"]))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert sorted(got) == sorted([("v", x, i + 1) for i, x in enumerate("mbzac")] + [("w", str(i), i + 1) for i in range(3)])


def test_vector_blocks(spark):
    from sward.operators.vectors import vector_summary, visit_vectors
    df = spark.createDataFrame([("v", 5, 1.0), ("v", 70_000, 3.0), ("v", 1, 0.0), ("w", 2, 4.0), ("w", 3, 4.0), ("w", 9, 4.0)], "id string, name long, n double")
    for block in (2, 8, 1 << 16):
        vec = visit_vectors(df, ["id"], block=block)
        assert all(r["places"] == sorted(r["places"]) and max(r["places"]) < block for r in vec.collect())
        got = {r["id"]: r for r in vector_summary(vec, ["id"], block).collect()}
        assert (got["v"]["n_species"], got["v"]["total"], got["v"]["first_species"], got["v"]["last_species"]) == (2, 4.0, 5, 70_000)
        assert abs(got["w"]["shannon"] - 1.0986122886681098) < 1e-12


def test_sorted_table(spark, tmp_path):
    from sward.sources.ordered import read_sorted, write_sorted
    keys = list(range(1000))
    random.Random(3).shuffle(keys)
    path = write_sorted(spark.createDataFrame([(k, f"x{k}") for k in keys], "name int, v string").repartition(5), str(tmp_path / "s"), "name", 7)
    assert sorted(rows(read_sorted(spark, path), "position", "name")) == [(k + 1, k) for k in range(1000)]
    some = read_sorted(spark, path, 100, 150, key="name")
    assert sorted(rows(some, "position", "name")) == [(k + 1, k) for k in range(100, 151)]
    assert sum(n for rel, n in leaf_files(some)) <= 4  # two folders at most, and the manifest
