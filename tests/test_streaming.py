import json
import os

from conftest import SF_SMALL, rows
from sward.operators.mapview import plot_series
from sward.plans import pipeline as P
from sward.session import local_path, shared_path
from sward.streaming.clicks import run_click_series


def test_click_stream_matches_batch_series(spark):
    sites_path = P.write_site_table(spark, SF_SMALL, shared_path(spark, "sites"))
    sites = spark.read.parquet(sites_path)
    plots = sorted(r[0] for r in sites.select("plot").distinct().collect())[:3]
    clicks = local_path(shared_path(spark, "clicks"))
    os.makedirs(clicks)
    events = [{"plot": plots[0], "metric": "speciesRichness", "ts": "2026-01-01T10:00:00"},
              {"plot": plots[1], "metric": "biotopePoints", "ts": "2026-01-01T10:00:05"},
              {"plot": plots[2], "metric": "nonsense", "ts": "2026-01-01T10:00:09"}]
    for i, e in enumerate(events):
        with open(os.path.join(clicks, f"c{i}.json"), "w") as f:
            f.write(json.dumps(e) + "\n")
    out = shared_path(spark, "click-out")
    q = run_click_series(spark, sites_path, clicks, out)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    for e, metric in zip(events, ["speciesRichness", "biotopePoints", "rlgRichness"]):
        g = sorted(rows(got.filter(f"plot = '{e['plot']}'"), "metric", "surveyYear", "y", "in_range", "title"))
        b = plot_series(sites, e["metric"], [e["plot"]])
        w = sorted((metric, *r) for r in rows(b, "surveyYear", "y", "in_range", "title"))
        assert g == w and len(g) > 0
