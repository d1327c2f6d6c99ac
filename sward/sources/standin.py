"""Stand-in survey tables derived from the driver's TPC-H-like tables.

The raw survey tables of the reference are not published, so the ecological
entities are mapped onto the test tables (SURVEY §7.3 / FIXTURES §C):

* visit   = (supplier, year(l_shipdate))  -> ``plot_key``, ``surveyYear``
* plot    = supplier, zero-padded to at least 5 characters, never cut
* species = part (``name`` = p_partkey)
* cover   = sum(l_quantity) per (visit, species); divided by 25 only after every sum
* traits  = functions of the part columns
* location = nation, block = region

Everything here is a lazy DataFrame over the Parquet scans, so the work grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.sources.tables import table

# Cover of a species in a visit is sum(l_quantity) / COVER_SCALE.
COVER_SCALE = 25.0
# Survey years used by the change classification on the stand-in data.
CHANGE_YEARS = (1996, 1997, 1998)


def survey_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """All survey years of the data, in order: as many rows as calendar years."""
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y")).where("y is not null").distinct()
    return sorted(r[0] for r in years.collect())


def plot_code(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    text = key.cast("string")
    return F.when(F.length(text) >= 5, text).otherwise(F.lpad(text, 5, "0"))


def visit_id(plot_key: Column | str, year: Column | str) -> Column:
    """``X<plot>_m_<year>`` — the reference's ``paste0("X", str_c(id, year, sep="_"))``."""
    year = F.col(year) if isinstance(year, str) else year
    return F.concat(F.lit("X"), plot_code(plot_key), F.lit("_m_"), year.cast("string"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per plot with its site attributes and coordinates (point layer)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    # nation and region have a fixed size (25 / 5 rows) -> broadcast is bounded
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
            .selectExpr(
                "s_suppkey AS plot_key",
                "CASE WHEN length(CAST(s_suppkey AS STRING)) >= 5 THEN CAST(s_suppkey AS STRING)"
                " ELSE lpad(CAST(s_suppkey AS STRING), 5, '0') END AS plot",
                "n_name AS location",
                "CAST(n_regionkey AS INT) AS block",
                "r_name AS blockRegion",
                "CASE s_suppkey % 4 WHEN 0 THEN 'south' WHEN 1 THEN 'north' WHEN 2 THEN 'east' ELSE 'west' END"
                " AS exposition",
                "CASE WHEN s_suppkey % 2 = 0 THEN 'water' ELSE 'land' END AS side",
                "CAST(1990 + n_nationkey % 12 AS INT) AS constructionYear",
                "CAST(2280 + (s_suppkey * 7) % 50 AS INT) AS riverkm",
                "s_acctbal / 10.0D AS distanceRiver",
                "12.0D + (s_suppkey % 97) / 100.0D AS lon",
                "48.0D + (s_suppkey % 89) / 100.0D AS lat",
                "CAST(5 + s_suppkey % 20 AS DOUBLE) AS finematerialDepth",
                "1.0D + (s_suppkey % 7) / 10.0D AS finematerialDensity",
                "(s_suppkey % 13) / 100.0D AS NtotalPerc",
            ))


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cover table: (plot_key, surveyYear, name, q) with q = sum(l_quantity).

    Grouped on the numeric keys; the string ids are built only on the much
    smaller per-visit results.  Partial aggregation runs before the shuffle.
    """
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("plot_key"),
                       F.year("l_shipdate").alias("surveyYear"),
                       F.col("l_partkey").alias("name"))
            .agg(F.sum("l_quantity").alias("q")))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw species traits, one row per species (``name``)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")

    def yes_no(cond: str) -> str:
        return f"CASE WHEN {cond} THEN 'yes' ELSE 'no' END"

    def brand_map(pairs: dict[str, str]) -> str:
        return "CASE p_brand " + " ".join(f"WHEN '{b}' THEN '{v}'" for b, v in pairs.items()) + " END"

    return p.selectExpr(
        "p_partkey AS name",
        "concat(replace(p_name, ' ', '_'),"
        " CASE WHEN p_size % 5 = 0 THEN concat('_ssp_', lower(p_type)) ELSE '' END) AS latin",
        "CASE p_type WHEN 'SMALL' THEN 'Poaceae' WHEN 'MEDIUM' THEN 'Cyperaceae' WHEN 'LARGE' THEN 'Fabaceae'"
        " WHEN 'ECONOMY' THEN 'Asteraceae' WHEN 'STANDARD' THEN 'Rosaceae' END AS family",
        "CAST(CASE WHEN p_size < 50 THEN 3000 + p_size * 65 END AS DOUBLE) AS sociology",
        "CASE WHEN p_size % 3 = 0 THEN 'yes' WHEN p_size % 3 = 1 THEN 'no' END AS targetHerb",
        f"{yes_no('p_size % 11 = 0')} AS targetGrass",
        "CASE WHEN p_brand = 'Brand#7' THEN 'yes' ELSE 'no' END AS targetArrhenatherion",
        f"{yes_no('p_size % 4 = 1')} AS nitrogenIndicator",
        f"{yes_no('p_size % 7 = 2')} AS ruderalIndicator",
        f"{yes_no('p_size % 6 = 0')} AS ffh6510",
        f"{yes_no('p_size % 9 = 0')} AS ffh6210",
        f"{brand_map({'Brand#1': '1', 'Brand#2': '2', 'Brand#3': '3', 'Brand#4': 'V', 'Brand#6': '*'})} AS rlg",
        f"{brand_map({'Brand#8': '1', 'Brand#9': '2', 'Brand#10': '3', 'Brand#14': 'V'})} AS rlb",
        "CASE WHEN p_brand = 'Brand#5' THEN '1' END AS table30",
        "CASE p_size % 10 WHEN 1 THEN '2' WHEN 3 THEN '3' WHEN 5 THEN '4' END AS table33",
        f"{brand_map({'Brand#11': '2', 'Brand#13': '3'})} AS table34",
    )


def vertices(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Vertex table of the line layer: (line_id, s1, s2, s3, lon, lat), ordered by (s1, s2, s3).

    Lineitem repeats some (order, line, part, supplier) rows, so vertices are
    distinct rows; ``distinct=False`` leaves the de-duplication to the caller
    (the geo operators fold it into their range shuffle).
    """
    li = table(spark, sf_dir, "lineitem")
    v = (li.select(F.col("l_orderkey").alias("line_id"), F.col("l_linenumber").alias("s1"),
                      F.col("l_partkey").alias("s2"), F.col("l_suppkey").alias("s3"),
                      (F.lit(12.0) + (F.col("l_partkey") % 1000) / F.lit(1000.0)).alias("lon"),
                      (F.lit(48.0) + (F.col("l_suppkey") % 100) / F.lit(100.0)).alias("lat")))
    return v.distinct() if distinct else v
