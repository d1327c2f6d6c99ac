import math

from pyspark.sql import functions as F

import os
import sys

from conftest import ROOT, SF_SMALL, rows
from sward.operators.metrics import COVER_NAMES, RICHNESS_NAMES, fused_metrics, species_cover
from sward.plans import pipeline as P
from sward.sources import standin

TRAITS = ("name string, family string, target string, targetHerb string, targetArrhenatherion string, "
          "leanIndicator string, nitrogenIndicator string, ruderalIndicator string, table33 string, "
          "table34 string, rlg string, rlb string, ffh6510 string, ffh6210 string")


def _traits(spark):
    t = [("poa", "Poaceae", "yes", "no", "yes", "yes", "no", "no", "2", None, "V", None, "yes", "no"),
         ("carex", "Cyperaceae", "no", "no", "no", "no", "yes", "no", None, "2", None, None, "no", "no"),
         ("salvia", "Lamiaceae", "yes", "yes", "no", "yes", "no", "yes", "3", None, "3", "3", "no", "yes"),
         ("mystery", None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(t, TRAITS)


def _metrics(spark, cover):
    c = spark.createDataFrame(cover, "id string, name string, n double")
    joined = species_cover(c, _traits(spark))
    return {r["id"]: r for r in fused_metrics(joined, ["id"]).collect()}


def test_three_t9_cases(spark):
    m = _metrics(spark, [
        ("grass_only", "poa", 10.0), ("grass_only", "carex", 5.0),
        ("herb_only", "salvia", 7.0),
        ("null_family", "poa", 4.0), ("null_family", "mystery", 6.0),
        ("all_zero", "poa", 0.0), ("all_zero", "salvia", 0.0),
    ])
    g = m["grass_only"]
    assert (g.graminoidCov, g.herbCov, g.accumulatedCov) == (15.0, 0.0, 15.0)
    h = m["herb_only"]
    assert (h.graminoidCov, h.herbCov, h.accumulatedCov) == (0.0, 7.0, 7.0)
    n = m["null_family"]
    # NULL family counts in neither group, but in richness
    assert (n.graminoidCov, n.herbCov, n.accumulatedCov, n.speciesRichness) == (4.0, 0.0, 4.0, 2)
    z = m["all_zero"]
    assert (z.accumulatedCov, z.speciesRichness, z.shannon) == (0.0, 0, 0.0)


def test_richness_and_covers(spark):
    m = _metrics(spark, [("v", "poa", 10.0), ("v", "carex", 5.0), ("v", "salvia", 7.25), ("v", "mystery", 1.0)])["v"]
    assert m.speciesRichness == 4
    assert m.rlgRichness == 2            # V and 3
    assert m.rlbRichness == 1
    assert m.targetRichness == 2 and m.targetCov == 17.2   # 17.25 -> 17.2 (R rounding, exact tie to even)
    assert m.leanCov == 17.2 and m.leanIndicatorRichness == 2
    assert m.table33Cov == 17.2 and m.table33_2Richness == 1 and m.table33_3Richness == 1
    assert m.table34_2Richness == 1 and m.ffh6510Richness == 1 and m.ffh6210Richness == 1
    s = 10 + 5 + 7.25 + 1
    h = -sum(x / s * math.log(x / s) for x in (10, 5, 7.25, 1))
    assert abs(m.shannon - h) < 1e-12
    assert m.shannon <= math.log(m.speciesRichness) + 1e-12


def test_fused_equals_unfused(spark):
    cov = standin.cover(spark, SF_SMALL)
    tr = P.species_traits(spark, SF_SMALL).select(*P.TRAIT_COLUMNS)
    j = species_cover(cov, tr, value="q")
    cols = ["plot_key", "surveyYear", "graminoidCov", "herbCov", "accumulatedCov", *COVER_NAMES, *RICHNESS_NAMES]
    fused = fused_metrics(j, ["plot_key", "surveyYear"], value="q", scale=25.0).select(*cols)
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from unfused import unfused_metrics
    unfused = unfused_metrics(j, ["plot_key", "surveyYear"], value="q", scale=25.0).select(*cols)
    a, b = sorted(rows(fused)), sorted(rows(unfused))
    assert len(a) > 0 and a == b


def test_visit_invariants(spark):
    st = P.site_table(spark, SF_SMALL)
    assert st.columns == list(P.SITE_COLUMNS)
    n = st.count()
    assert st.select("id").distinct().count() == n
    assert st.select("plot", "surveyYear").distinct().count() == n
    # type -> (ffh, points) is functional
    assert st.groupBy("biotopeType").agg(F.countDistinct("ffh", "biotopePoints").alias("k")).filter("k > 1").count() == 0
    assert st.filter("accumulatedCov <= 0").count() == 0


def test_visit_properties(spark):
    vt = P.visit_types(spark, SF_SMALL)
    # Shannon's H never exceeds ln(richness) (equality only for even covers)
    assert vt.filter("shannon > ln(CAST(speciesRichness AS DOUBLE)) + 1e-12").count() == 0
    # every visit gets exactly one type
    assert vt.filter("biotopeType IS NULL").count() == 0
    assert vt.select("plot_key", "surveyYear").distinct().count() == vt.count()
    # site attributes are constant per plot
    st = P.site_table(spark, SF_SMALL)
    per_plot = st.groupBy("plot").agg(F.countDistinct("location", "exposition", "side", "block", "riverkm")
                                      .alias("k"))
    assert per_plot.filter("k <> 1").count() == 0
