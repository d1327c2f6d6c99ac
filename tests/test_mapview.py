from conftest import rows
from sward.operators.mapview import (first_visit, plot_series, reference_stats, resolve_metric,
                                     series_with_reference)

SITES = "id string, plot string, location string, exposition string, side string, surveyYear int, " \
        "speciesRichness int, biotopePoints int, rlgRichness int, biotopeType string"


def _sites(spark, data=None):
    data = data or [("X01_m_2017", "01", "Loc & <A>", "north", "land", 2017, 30, 12, 2, "G214-GE6510"),
                    ("X01_m_2018", "01", "Loc & <A>", "north", "land", 2018, 55, 8, 9, "G213"),
                    ("X02_m_2017", "02", "B", "south", "water", 2017, 20, 13, 1, "G312-GT6210")]
    return spark.createDataFrame(data, SITES)


def test_metric_dispatch_default():
    assert resolve_metric("speciesRichness") == "speciesRichness"
    assert resolve_metric("biotopePoints") == "biotopePoints"
    assert resolve_metric("anything") == "rlgRichness"


def test_empty_selection_gives_no_rows(spark):
    assert plot_series(_sites(spark), "speciesRichness", []).count() == 0
    assert plot_series(_sites(spark), "speciesRichness", None).count() == 0


def test_series_range_and_title(spark):
    got = rows(plot_series(_sites(spark), "speciesRichness", ["01"]).orderBy("surveyYear"), "y", "in_range", "title")
    assert got == [(30, True, "Loc &amp; &lt;A&gt;. ID: 01"), (55, False, "Loc &amp; &lt;A&gt;. ID: 01")]


def test_reference_stats_null_and_single_row(spark):
    one = reference_stats(_sites(spark, [("X", "01", "L", "n", "l", 2017, 5, 8, 1, "G213")]), "speciesRichness")
    assert rows(one, "mean", "upper", "lower") == [(5.0, None, None)]
    with_null = _sites(spark, [("X", "01", "L", "n", "l", 2017, None, 8, 1, "G213"),
                               ("Y", "02", "L", "n", "l", 2018, 4, 8, 1, "G213")])
    assert rows(reference_stats(with_null, "speciesRichness"), "mean") == [(None,)]


def test_series_with_reference_is_equi_join(spark):
    df = series_with_reference(_sites(spark), "biotopePoints", ["01", "02"])
    assert df.count() == 3
    mean = rows(df, "mean")[0][0]
    assert abs(mean - 11.0) < 1e-12
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_first_visit(spark):
    got = sorted(rows(first_visit(_sites(spark)), "plot", "surveyYear", "id"))
    assert got == [("01", 2017, "X01_m_2017"), ("02", 2017, "X02_m_2017")]
