"""Map layers (S5, S6) and the wide plot sheet, as stand-ins on the driver tables.

The reference reads shapefiles that are not in its repository; here a point
layer is a table ``(plot, lon, lat, ...)`` and a line layer an attribute table
plus a vertex table ``(line_id, order..., lon, lat)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.sources import standin
from sward.sources.tables import table

# ---- fixed values of the reference: attributes of the line layer ----
LINE_ATTRIBUTES = ("BAUJAHR", "SANIERUNG", "GWO_L", "L_GEW_KNZ", "LKR_L", "GEM_L", "WWA_L", "BETREIBE_L", "LAGE_FLI_L")
# ---------------------------------------------------------------------

# measure families of the wide plot sheet (one column per measure and year)
SHEET_MEASURES = ("vegetationCov", "vegetationHeight", "opensoilCov", "mossCov", "litterCov", "botanist")
SHEET_NUMERIC = ("vegetationCov", "vegetationHeight", "opensoilCov", "mossCov", "litterCov")


def point_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key + geometry (lon/lat in SRID 4326)."""
    return standin.plots(spark, sf_dir).select("plot", "lon", "lat")


def line_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 attributes of the dike lines (one line per order)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("line_id"),
        F.year("o_orderdate").cast("string").alias("BAUJAHR"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("<"), F.col("o_orderstatus"), F.lit("> & "), F.col("o_orderpriority")))
         .alias("SANIERUNG"),
        F.col("o_orderstatus").alias("GWO_L"),
        F.col("o_orderpriority").alias("BETREIBE_L"),
    )


def line_attributes_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine attributes; district, office and municipality come from the order's customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_id"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation and region have a fixed size
    where = c.join(F.broadcast(n), "n_nationkey", "left").join(F.broadcast(r), "r_regionkey", "left")
    more = o.join(where, "c_custkey", "left").select(
        "line_id", F.concat(F.lit("1"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")).alias("L_GEW_KNZ"),
        F.col("n_name").alias("LKR_L"), F.col("c_name").alias("GEM_L"), F.col("r_name").alias("WWA_L"),
        F.when(F.col("c_custkey") % 2 == 0, "links").otherwise("rechts").alias("LAGE_FLI_L"))
    return line_attributes(spark, sf_dir).join(more, "line_id").select("line_id", *LINE_ATTRIBUTES)


def part_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of multi-part lines: (line_id, part, s1, s2, s3, lon, lat), repeated rows left in."""
    v = standin.vertices(spark, sf_dir, distinct=False)
    return v.withColumn("part", F.floor((F.col("s1") - 1) / 3).cast("int"))


def line_layer_with_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes joined to the vertex count of each line.

    Distinct vertices (hash on the whole row), then a partial count per line, so a
    line with a third of all vertices is spread over many tasks.
    """
    v = standin.vertices(spark, sf_dir, distinct=False)
    counts = v.distinct().groupBy("line_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    return line_attributes(spark, sf_dir).join(counts, "line_id", "left")


def plot_sheet(spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None) -> DataFrame:
    """Wide plot sheet: one row per plot, ``<measure>_<year>`` columns (one partial aggregate).

    The survey years are those of the data (a scan of one column), unless given.
    """
    li = table(spark, sf_dir, "lineitem")
    years = standin.survey_years(spark, sf_dir) if years is None else years
    aggs = []
    for y in years:
        iy = f"year(l_shipdate) = {int(y)}"
        aggs += [
            f"sum(CASE WHEN {iy} THEN l_quantity END) / {standin.COVER_SCALE!r}D AS vegetationCov_{y}",
            f"max(CASE WHEN {iy} THEN l_quantity END) AS vegetationHeight_{y}",
            f"CAST(count_if({iy} AND l_returnflag = 'R') AS DOUBLE) AS opensoilCov_{y}",
            f"min(CASE WHEN {iy} THEN l_quantity END) AS mossCov_{y}",
            f"CAST(count_if({iy}) AS DOUBLE) / 4.0D AS litterCov_{y}",
            f"min(CASE WHEN {iy} THEN l_linestatus END) AS botanist_{y}",
        ]
    return (li.groupBy(F.col("l_suppkey").alias("plot_key")).agg(*[F.expr(a) for a in aggs])
            .withColumn("plot", standin.plot_code("plot_key")).drop("plot_key"))
