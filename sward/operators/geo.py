"""Light geodata: centroids (A28), path lengths (M7) and ring areas (M8).

Coordinates are WGS 84 degrees (SRID 4326).  Lengths use the haversine
formula, areas the spherical-excess shoelace sum, on a sphere of the mean
Earth radius.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.operators.sequence import (consecutive_pairs, ends_from_segments, ordered_layout, pairs_and_segments,
                                     ranged, segments_in_layout)

# ---- fixed values ----
EARTH_RADIUS_KM = 6371.0088
SRID = 4326
# ----------------------


def centroids(points: DataFrame, group: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Mean longitude / latitude per group (A28), one partial aggregate."""
    return points.groupBy(group).agg(F.avg(lon).alias("longitude_center"), F.avg(lat).alias("latitude_center"),
                                     F.count(F.lit(1)).alias("n_plots"))


def haversine_km(plon: Column, plat: Column, lon: Column, lat: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat - plat) / 2), 2)
         + F.cos(F.radians(plat)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - plon) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def _shoelace_term(lon: Column, lat: Column, nlon: Column, nlat: Column) -> Column:
    return F.radians(nlon - lon) * (F.lit(2.0) + F.sin(F.radians(lat)) + F.sin(F.radians(nlat)))


def path_lengths(vertices: DataFrame, line: str, order: Sequence[str],
                 lon: str = "lon", lat: str = "lat", distinct: bool = False) -> DataFrame:
    """Great-circle length in km of each path (M7); single-vertex paths have no row.

    ``distinct=True`` drops repeated vertex rows inside the layout's exchange.
    """
    vals = [lon, lat]
    pairs = consecutive_pairs(vertices, line, order, vals, distinct=distinct)
    seg = haversine_km(F.col(f"p_{lon}"), F.col(f"p_{lat}"), F.col(lon), F.col(lat))
    return pairs.groupBy(line).agg(F.sum(seg).alias("km"))


def _ring_km2(t: Column) -> Column:
    return F.abs(t) * F.lit(EARTH_RADIUS_KM) * F.lit(EARTH_RADIUS_KM) / F.lit(2.0)


def ring_areas(vertices: DataFrame, line: str, order: Sequence[str],
               lon: str = "lon", lat: str = "lat", min_vertices: int = 3, distinct: bool = False) -> DataFrame:
    """Area in km^2 of each ring closed from its last vertex back to the first (M8).

    Edge terms of consecutive vertices and the closing edge (last -> first)
    are summed per ring; all branches read one written layout.
    """
    vals = [lon, lat]
    x = segments_in_layout(ordered_layout(vertices, line, order, vals, distinct=distinct),
                           line, order, vals)
    pairs, segs = pairs_and_segments(x, line, vals)
    terms = pairs.select(line, _shoelace_term(F.col(f"p_{lon}"), F.col(f"p_{lat}"),
                                              F.col(lon), F.col(lat)).alias("t"), F.lit(0).alias("ring"))
    ends = ends_from_segments(segs, line, vals).filter(F.col("n") >= min_vertices)
    wrap = ends.select(line, _shoelace_term(F.col(f"last_{lon}"), F.col(f"last_{lat}"),
                                            F.col(f"first_{lon}"), F.col(f"first_{lat}")).alias("t"),
                       F.lit(1).alias("ring"))
    total = (terms.unionByName(wrap).groupBy(line)
             .agg(F.sum("t").alias("t"), F.max("ring").alias("ring"))
             .filter(F.col("ring") == 1))
    return total.select(line, _ring_km2(F.col("t")).alias("km2"))


def line_pieces(vertices: DataFrame, line: str, part: str, order: Sequence[str], lon: str = "lon", lat: str = "lat",
                piece: int = 4096, distinct: bool = False) -> DataFrame:
    """S6 geometry: (line, part, piece, n_vertices, wkt), the parts of each line in vertex order.

    A part of up to ``piece`` + 1 vertices is one row; a longer one is cut into pieces that share their end vertices,
    so the pieces draw the same line.  A hot line is never one sort or one value: vertices are numbered from
    the range layout (position in the partition, plus the vertices of the part's earlier segments), and each piece is
    assembled from at most ``piece`` + 1 rows.  A part of one vertex is a POINT.
    """
    r = ranged(vertices.select(line, part, *order, lon, lat), [line, part, *order], None, distinct)
    segs = r.groupBy("_pid", line, part).agg(F.min("_local").alias("_start"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(line, part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.select("_pid", line, part, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"))
    v = r.join(segs, ["_pid", line, part]).withColumn("_i", F.col("_local") + F.col("_shift"))
    own = F.floor(F.col("_i") / piece)
    shared = (F.col("_i") % piece == 0) & (F.col("_i") > 0)
    v = v.withColumn("piece", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))))
    xy = F.concat_ws(" ", *[F.col(c).cast("decimal(12,6)").cast("string") for c in (lon, lat)])
    out = v.groupBy(line, part, "piece").agg(F.count(F.lit(1)).alias("n_vertices"),
                                             F.array_sort(F.collect_list(F.struct("_i", xy.alias("xy")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["xy"]), ", ")
    kind = F.when(F.col("n_vertices") > 1, "LINESTRING (").otherwise("POINT (")
    return (out.where((F.col("n_vertices") > 1) | (F.col("piece") == 0))
            .select(line, part, "piece", "n_vertices", F.concat(kind, text, F.lit(")")).alias("wkt")))
