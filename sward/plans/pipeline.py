"""Batch pipeline E1: raw survey tables -> one analysis row per visit.

Physical shape (checked with ``explain``): lineitem scan -> partial aggregate
per (visit, species) -> exchange -> trait join (broadcast when Spark's size
check allows, shuffle join otherwise) -> partial aggregate per visit ->
exchange -> site attributes join -> CASE rules -> projection.  Every
aggregate is pre-combined before its shuffle, so a hot supplier or a hot
species never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.functions.rsem import r_round_sql, str_c, str_sub
from sward.operators.biotope import Thresholds, classify
from sward.operators.change import with_change_type
from sward.operators.metrics import fused_metrics, species_cover, trait_masks
from sward.operators.reshape import measure_years, wide_to_visits
from sward.operators.traits import trait_flags
from sward.sources import standin
from sward.sources.layers import SHEET_MEASURES, SHEET_NUMERIC

# the reference's final column contract (17 columns, in order)
SITE_COLUMNS = ("id", "plot", "block", "location", "locationYear", "riverkm", "distanceRiver", "surveyYear",
                "exposition", "side", "accumulatedCov", "speciesRichness", "rlgRichness", "biotopeType", "ffh",
                "biotopePoints", "botanist")

TRAIT_COLUMNS = ("name", "family", "target", "targetHerb", "targetArrhenatherion", "leanIndicator",
                 "nitrogenIndicator", "ruderalIndicator", "table33", "table34", "rlg", "rlb", "ffh6510", "ffh6210")


def species_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trait_flags(standin.traits(spark, sf_dir))


VISIT_KEYS = ("plot_key", "surveyYear")


def visit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused A1-A21 per visit, with the visit id and plot code.

    One plan for every size: (visit, species) exchange with map-side combine, join
    with the trait bitmasks, partial aggregate per visit before the per-visit
    exchange.  A hot visit's species are spread by the first exchange, and the last
    one carries one partial row per (visit, task).
    """
    cov = standin.cover(spark, sf_dir)
    joined = species_cover(cov, trait_masks(species_traits(spark, sf_dir)), value="q")
    m = fused_metrics(joined, list(VISIT_KEYS), value="q", scale=standin.COVER_SCALE)
    return m.withColumns({"id": standin.visit_id("plot_key", "surveyYear"),
                          "plot": standin.plot_code("plot_key")})




def visit_types(spark: SparkSession, sf_dir: str, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return classify(visit_metrics(spark, sf_dir), thresholds)


def location_year(location, construction_year):
    """F8: upper(first 3 letters of location) + "-" + construction year."""
    return str_c(F.upper(str_sub(location, 1, 3)), construction_year, sep="-")


def build_visits(cover: DataFrame, traits: DataFrame, keys: Sequence[str] = ("id",), value: str = "n", scale: float = 1.0,
                 thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Metrics and biotope type per visit from a long cover table (keys, name, value) and raw traits."""
    masks = trait_masks(trait_flags(traits))
    return classify(fused_metrics(species_cover(cover, masks, value=value), list(keys), value=value, scale=scale), thresholds)


def build_sites(sites: DataFrame, cover: DataFrame, traits: DataFrame, years: Sequence[int] | None = None,
                thresholds: Thresholds = Thresholds(), change_years: Sequence[int] | None = None) -> DataFrame:
    """E1 on the survey's own tables: every computed column, one row per visit of the sheet.

    sites: the wide plot sheet (id such as ``01_m``, site attributes, ``<measure>_<year>`` columns); cover: long
    (id such as ``X01_m_2017``, name, n), e.g. from :func:`sward.sources.matrix.read_matrix`; traits: raw traits by name.
    Survey years come from the sheet's columns.  A sheet without three survey years needs ``change_years``.
    """
    measures = [m for m in SHEET_MEASURES if any(c.startswith(m + "_") for c in sites.columns)]
    years = list(years or measure_years(sites, measures))
    ids = [c for c in sites.columns if not any(c.startswith(m + "_") for m in measures)]
    visits = wide_to_visits(sites, ids, measures, years, numeric=SHEET_NUMERIC)
    raw = F.col("id")
    visits = visits.withColumns({"id": F.concat(F.lit("X"), str_c(raw, F.col("surveyYear"), sep="_")),
                                 "plot": F.get(F.split(raw, "_"), 0), "position": F.get(F.split(raw, "_"), 1)})
    # the sheet's visits stay (the reference joins the metrics to them); a visit without cover has no metrics
    return enrich(visits.join(build_visits(cover, traits, thresholds=thresholds), "id", "left"), change_years or years[:3])


def enrich(s: DataFrame, change_years: Sequence[int], key: str = "plot") -> DataFrame:
    """The change class (J5) and the derived visit columns; rows already partitioned by ``key`` are not shuffled again."""
    return with_change_type(s, change_years, key).selectExpr(
        "*",
        "concat(upper(substring(location, 1, 3)), '-', CAST(constructionYear AS STRING)) AS locationYear",
        "surveyYear - constructionYear AS plotAge",
        # R's x/0 (NaN, Inf) becomes NULL
        "try_divide(CAST(targetCov AS DOUBLE), CAST(accumulatedCov AS DOUBLE)) AS targetCovratio",
        "try_divide(CAST(graminoidCov AS DOUBLE), CAST(accumulatedCov AS DOUBLE)) AS graminoidCovratio",
        "try_divide(CAST(targetRichness AS DOUBLE), CAST(speciesRichness AS DOUBLE)) AS targetRichratio",
        "try_divide(shannon, ln(CAST(speciesRichness AS DOUBLE))) AS eveness",
    )


def finish(s: DataFrame, columns: Sequence[str] = SITE_COLUMNS) -> DataFrame:
    """R rounding, ``accumulatedCov > 0``, the column contract."""
    s = s.withColumns({
        "distanceRiver": F.expr(r_round_sql("distanceRiver", 1)),
        "accumulatedCov": F.expr(r_round_sql("accumulatedCov", 1)),
    })
    return s.filter(F.col("accumulatedCov") > 0).select(*columns)


def sites(spark: SparkSession, sf_dir: str, thresholds: Thresholds = Thresholds(),
          change_years: Sequence[int] = standin.CHANGE_YEARS) -> DataFrame:
    """Every computed visit column of the stand-in tables (T12: built, projected late)."""
    s = visit_types(spark, sf_dir, thresholds).join(standin.plots(spark, sf_dir).drop("plot"), "plot_key", "left")
    botanist = ("CASE WHEN (plot_key + surveyYear) % 7 = 0 THEN CAST(NULL AS STRING)"
                " ELSE concat('botanist_', CAST((plot_key + surveyYear) % 3 AS STRING)) END")
    return enrich(s.withColumn("botanist", F.expr(botanist)), change_years, key="plot_key")


def site_table(spark: SparkSession, sf_dir: str, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Finalisation: R rounding, ``accumulatedCov > 0``, the 17-column contract."""
    return finish(sites(spark, sf_dir, thresholds))


def write_site_table(spark: SparkSession, sf_dir: str, path: str, csv_path: str | None = None) -> str:
    """E1 sinks: Parquet partitioned by survey year (pruned by year filters), optional CSV."""
    from sward.sources.csv import write_csv, write_parquet
    # range layout on (year, plot), sorted: few balanced files per year, and row-group
    # min/max statistics on plot let a pushed-down plot filter skip most of the table
    st = site_table(spark, sf_dir).repartitionByRange("surveyYear", "plot").sortWithinPartitions("surveyYear", "plot")
    write_parquet(st, path, partition_by=("surveyYear",))
    if csv_path:
        write_csv(spark.read.parquet(path).select(*SITE_COLUMNS), csv_path)
    return path


def analysis_table(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The analysis table as the dashboard reads it.

    ``path``: a table that :func:`write_site_table` wrote; the map and chart queries
    then scan it with column pruning.  Without it the pipeline is composed lazily
    into the query; nothing is written or kept between queries.
    """
    if path:
        return spark.read.parquet(path).select(*SITE_COLUMNS)
    return site_table(spark, sf_dir)


# column types of the analysis table when read back from its CSV form
SITE_CSV_TYPES = {
    "id": "string", "plot": "string", "block": "int", "location": "string", "locationYear": "string",
    "riverkm": "int", "distanceRiver": "double", "surveyYear": "int", "exposition": "string", "side": "string",
    "accumulatedCov": "double", "speciesRichness": "int", "rlgRichness": "int", "biotopeType": "string",
    "ffh": "string", "biotopePoints": "int", "botanist": "string",
}


def read_analysis_csv(spark: SparkSession, path: str) -> DataFrame:
    """The dashboard's reader of the analysis table CSV (NA tokens "na" / "NA", plot kept as text)."""
    from sward.sources.csv import APP_NA, read_typed_csv
    return read_typed_csv(spark, path, SITE_CSV_TYPES, tokens=APP_NA, uniform=True).select(*SITE_COLUMNS)
