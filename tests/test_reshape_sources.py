import datetime
import os

from conftest import SF_SMALL, rows
from sward.operators.reshape import (columns_matching, pivot_measures, relocate, require_columns,
                                     unpivot_measures, wide_to_visits)
from sward.session import local_path, shared_path
from sward.sources.csv import read_typed_csv, write_csv
from sward.sources.layers import SHEET_MEASURES, SHEET_NUMERIC, plot_sheet

import pytest


def test_unpivot_then_pivot_equals_explode(spark):
    wide = plot_sheet(spark, SF_SMALL)
    years = tuple(range(1995, 2002))
    long = unpivot_measures(wide, ["plot"], SHEET_MEASURES)
    a = pivot_measures(long, ["plot"], SHEET_MEASURES, numeric=SHEET_NUMERIC)
    b = wide_to_visits(wide, ["plot"], SHEET_MEASURES, years, numeric=SHEET_NUMERIC)
    cols = ["plot", "surveyYear", *SHEET_MEASURES]
    ra, rb = sorted(rows(a.select(*cols)), key=str), sorted(rows(b.select(*cols)), key=str)
    assert len(ra) == wide.count() * 7 and ra == rb


def test_pattern_projection(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3.0)], "id int, name string, vegetationCov_2017 double, mossCov_2017 double")
    assert columns_matching(df, prefixes=["vegetationCov"]) == ["vegetationCov_2017"]
    assert columns_matching(df, suffixes=["_2017"]) == ["vegetationCov_2017", "mossCov_2017"]
    assert columns_matching(df, numeric=True) == ["id", "vegetationCov_2017", "mossCov_2017"]
    assert relocate(df, ["name"], after="mossCov_2017").columns[-1] == "name"
    with pytest.raises(ValueError):
        require_columns(df, ["id", "missing"])


def test_csv_tokens_decimal_mark_and_sink(spark):
    folder = local_path(shared_path(spark, "test-csv"))
    assert folder.startswith("/")
    os.makedirs(folder, exist_ok=True)
    src = os.path.join(folder, "in.csv")
    with open(src, "w") as f:
        f.write("name;cover;day;note\n")
        f.write("a;1,5;2017-05-01;ok\n")
        f.write("b;na;NA;\n")
        f.write("c;x2;2018-13-01;NA\n")
    df = read_typed_csv(spark, src, {"name": "string", "cover": "double", "day": "date:yyyy-MM-dd", "note": "string"},
                        sep=";", dec=",")
    assert rows(df) == [("a", 1.5, datetime.date(2017, 5, 1), "ok"), ("b", None, None, None), ("c", None, None, None)]
    out = local_path(write_csv(df, shared_path(spark, "test-csv-out")))
    text = "".join(open(os.path.join(out, p)).read() for p in sorted(os.listdir(out)) if p.endswith(".csv"))
    assert "b,NA,NA,NA" in text


def test_csv_binds_columns_by_header_name(spark):
    folder = local_path(shared_path(spark, "test-csv-order"))
    os.makedirs(folder, exist_ok=True)
    src = os.path.join(folder, "in.csv")
    with open(src, "w") as f:
        f.write("note,cover,name,extra\n")
        f.write("x,2.5,a,NA\n")
    df = read_typed_csv(spark, src, {"name": "string", "cover": "double"})
    assert rows(df.select("name", "cover", "note", "extra")) == [("a", 2.5, "x", None)]
    with pytest.raises(ValueError):
        read_typed_csv(spark, src, {"missing": "double"})
    with pytest.raises(ValueError):  # the second line has no such column
        read_typed_csv(spark, src, {"name": "string"}, skip=1)


def test_analysis_table_csv_round_trip(spark):
    from sward.plans import pipeline as P
    csv_path = shared_path(spark, "rt-csv")
    pq = P.write_site_table(spark, SF_SMALL, shared_path(spark, "rt-parquet"), csv_path=csv_path)
    a = spark.read.parquet(pq).select(*P.SITE_COLUMNS)
    b = P.read_analysis_csv(spark, csv_path)
    assert [f.name for f in b.schema] == [f.name for f in a.schema]
    ra, rb = sorted(rows(a), key=str), sorted(rows(b), key=str)
    assert len(ra) > 0 and ra == rb
    # a NULL botanist is written as NA and read back as NULL
    assert any(r[-1] is None for r in rb)
