"""Query catalogue: name -> (Spark query, DuckDB oracle SQL).

Each Spark query takes ``(spark, sf_dir)``, reads the driver's tables and
returns a lazy DataFrame over all of their rows.  Column names and types are
the same on both sides; doubles from inexact arithmetic are rounded to 6
digits (4 for areas) on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.functions.rsem import r_if
from sward.operators.metrics import COVER_NAMES, RICHNESS_NAMES
from sward.plans import oracle as O
from sward.plans import pipeline as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


#: Vertices of one geometry row (plus the shared end).
GEOMETRY_PIECE = 4096
KEYS = ("id", "plot", "surveyYear")
COVER_OUT = ("graminoidCov", "herbCov", "accumulatedCov", *COVER_NAMES)


# --------------------------------------------------------------- metrics
@register("cover_metrics", O.with_views(["v_visits"], f"""
select {", ".join(KEYS + COVER_OUT)} from v_visits"""))
def cover_metrics(spark, sf_dir):
    """A1-A9 (+J3 fused): covers per visit."""
    return P.visit_metrics(spark, sf_dir).select(*KEYS, *COVER_OUT)


@register("richness_metrics", O.with_views(["v_visits"], f"""
select {", ".join(KEYS + RICHNESS_NAMES)} from v_visits"""))
def richness_metrics(spark, sf_dir):
    """A10-A20 (+J4 fused): richness counts per visit."""
    return P.visit_metrics(spark, sf_dir).select(*KEYS, *RICHNESS_NAMES)


@register("diversity", O.with_views(["v_visits"], """
select id, plot, surveyYear, speciesRichness, round(shannon, 6) as shannon,
 round(case when speciesRichness <= 1 then null else shannon / ln(speciesRichness) end, 6) as eveness
from v_visits"""))
def diversity(spark, sf_dir):
    """A21 Shannon H and F11 evenness = H / ln(richness) (0/0 -> NULL)."""
    m = P.visit_metrics(spark, sf_dir)
    even = F.try_divide(F.col("shannon"), F.ln(F.col("speciesRichness").cast("double")))
    return m.select(*KEYS, "speciesRichness", F.round("shannon", 6).alias("shannon"),
                    F.round(even, 6).alias("eveness"))


# --------------------------------------------------------------- biotope
@register("biotope_types", O.with_views(["v_points"], """
select id, plot, surveyYear, biotopeType, ffh, baykompv from v_points"""))
def biotope_types(spark, sf_dir):
    """Rule chain, FFH class and short code per visit."""
    return P.visit_types(spark, sf_dir).select(*KEYS, "biotopeType", "ffh", "baykompv")


@register("biotope_points", O.with_views(["v_points"], """
select id, plot, surveyYear, biotopeType, biotopePoints,
 case when biotopePoints >= 8 then 'yes' else 'no' end as min8,
 case when biotopePoints >= 9 then 'yes' else 'no' end as min9
from v_points"""))
def biotope_points(spark, sf_dir):
    """Points per type and the 8 / 9 point thresholds."""
    return P.visit_types(spark, sf_dir).select(*KEYS, "biotopeType", "biotopePoints", "min8", "min9")


def _change_sql() -> str:
    return O.with_views(["v_points"], _change_body())


def _change_body() -> str:
    n = "'non-FFH'"

    def r_if(cond: str, yes: str, no: str) -> str:
        return f"case when {cond} then {yes} when not ({cond}) then {no} end"

    a, b, c = "x96", "x97", "x98"
    better = f"({a} = {n} and {b} <> {n} and {c} <> {n})"
    change = (f"(({a} <> {n} and {b} = {n} and {c} <> {n}) or ({a} = {n} and {b} <> {n} and {c} = {n}) or "
              f"({a} = {n} and {b} = {n} and {c} <> {n}) or ({a} <> {n} and {b} <> {n} and {c} = {n}))")
    all_n = f"({a} = {n} and {b} = {n} and {c} = {n})"
    all_6510 = f"({a} = '6510' and {b} = '6510' and {c} = '6510')"
    all_6210 = f"({a} = '6210' and {b} = '6210' and {c} = '6210')"
    any_ffh = f"({a} <> {n} and {b} <> {n} and {c} <> {n})"
    expr = r_if(better, "'better'", r_if(change, "'change'", r_if(all_n, "'non-FFH'", r_if(
        all_6510, "'FFH6510'", r_if(all_6210, "'FFH6210'", r_if(any_ffh, "'any-FFH'", "'worse'"))))))
    return f"""
select plot, x96, x97, x98, {expr} as changeType
from (select plot, max(case when surveyYear = 1996 then ffh end) as x96,
             max(case when surveyYear = 1997 then ffh end) as x97,
             max(case when surveyYear = 1998 then ffh end) as x98
      from v_points group by plot) w"""


@register("change_type", _change_sql())
def change_type(spark, sf_dir):
    """R7 + C22: FFH class per year pivoted per plot, then the change class."""
    from sward.operators.change import change_classes
    from sward.sources.standin import CHANGE_YEARS
    return change_classes(P.visit_types(spark, sf_dir).select("plot", "surveyYear", "ffh"), CHANGE_YEARS)


# --------------------------------------------------------------- full pipeline
@register("site_table", O.with_views(["v_site"], "select * from v_site"))
def site_table(spark, sf_dir):
    """The reference's 17-column analysis table."""
    return P.site_table(spark, sf_dir)


@register("site_change", O.with_views(["v_site"], """
select s.*, c.changeType from v_site s left join c on c.plot = s.plot""", extra=[("c", _change_body())]))
def site_change(spark, sf_dir):
    """The analysis table with the change class of its plot on every visit; one scan, one exchange of the plot."""
    return P.finish(P.sites(spark, sf_dir), (*P.SITE_COLUMNS, "changeType"))


@register("change_path", O.with_views(["v_points"], """
select plot, string_agg(coalesce(s, '-'), '' order by y) as path, cast(count(s) as integer) as n_years,
 cast(count(case when prev = 'N' and s = 'F' then 1 end) as integer) as gains,
 cast(count(case when prev = 'F' and s = 'N' then 1 end) as integer) as losses,
 case when count(s) < count(*) then null
  when count(case when prev <> s then 1 end) = 1 and right(string_agg(s, '' order by y), 2) = 'FF' then 'better'
  when count(case when prev <> s then 1 end) = 1 and right(string_agg(s, '' order by y), 2) = 'NN' then 'worse'
  when count(case when prev <> s then 1 end) > 0 then 'change'
  when min(s) = 'N' then 'non-FFH'
  when count(distinct ffh) = 1 then concat('FFH', min(ffh)) else 'any-FFH' end as pathType
from (select *, lag(s ignore nulls) over (partition by plot order by y) as prev
      from (select p.plot, y.y, v.ffh, case when v.ffh = 'non-FFH' then 'N' when v.ffh is not null then 'F' end as s
            from (select distinct plot from v_points) p cross join (select distinct surveyYear as y from v_points) y
            left join v_points v on v.plot = p.plot and v.surveyYear = y.y) g) w
group by plot"""))
def change_path(spark, sf_dir):
    """R7 + C22 over all survey years of the data: state path, gains, losses and class of every plot."""
    from sward.operators.change import change_paths
    return change_paths(P.visit_types(spark, sf_dir).select("plot", "surveyYear", "ffh"))


# --------------------------------------------------------------- keys, labels, levels
def _esc_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _na(x: str) -> str:
    return f"coalesce({x}, 'NA')"


@register("visit_key_codec", O.with_views(["v_plots"], """
select id, regexp_extract(id, '^X([0-9]+)_', 1) as plot, split_part(id, '_', 2) as position,
 cast(plot_key as varchar) as plot_display, surveyYear,
 cast(surveyYear as varchar) as surveyYearF, cast(surveyYear - 1 as varchar) as surveyYearFminus,
 cast(constructionYear as varchar) as constructionYearF, cast(constructionYear + 1 as varchar) as constructionYearFplus,
 cast(surveyYear - constructionYear as integer) as plotAge
from (select concat('X', concat(printf('%05d', v.plot_key), '_m'), '_', cast(v.surveyYear as varchar)) as id,
             v.plot_key, v.surveyYear, p.constructionYear
      from (select distinct l_suppkey as plot_key, cast(year(l_shipdate) as integer) as surveyYear from lineitem) v
      left join v_plots p on v.plot_key = p.plot_key) k"""))
def visit_key_codec(spark, sf_dir):
    """Build the visit id, decode plot / position, display id, year categories."""
    from sward.functions.rsem import str_c, strip_number_text
    from sward.sources import standin
    from sward.sources.tables import table
    li = table(spark, sf_dir, "lineitem")
    visits = li.select(F.col("l_suppkey").alias("plot_key"), F.year("l_shipdate").alias("surveyYear")).distinct()
    plots = standin.plots(spark, sf_dir).select("plot_key", "constructionYear")
    v = visits.join(plots, "plot_key", "left")
    raw_id = F.concat(standin.plot_code("plot_key"), F.lit("_m"))
    v = v.withColumn("id", F.concat(F.lit("X"), str_c(raw_id, F.col("surveyYear"), sep="_")))
    parts = F.split("id", "_")  # X<plot>_<position>_<year>: the plot has five digits or more
    plot = F.expr("substring(split(id, '_')[0], 2)")
    return v.select(
        "id", plot.alias("plot"), F.get(parts, 1).alias("position"),
        strip_number_text(plot).alias("plot_display"), "surveyYear",
        F.col("surveyYear").cast("string").alias("surveyYearF"),
        (F.col("surveyYear") - 1).cast("string").alias("surveyYearFminus"),
        F.col("constructionYear").cast("string").alias("constructionYearF"),
        (F.col("constructionYear") + 1).cast("string").alias("constructionYearFplus"),
        (F.col("surveyYear") - F.col("constructionYear")).cast("int").alias("plotAge"))


@register("trait_flags", O.with_views(["v_flags"], """
select name, leanIndicator, target, ruderal from v_flags"""))
def trait_flags(spark, sf_dir):
    """Lean indicator, target species, ruderal by sociology range."""
    return P.species_traits(spark, sf_dir).select("name", "leanIndicator", "target", "ruderal")


@register("ellenberg_groups", O.with_views(["v_flags"], """
select name, sociology, targetEllenberg from v_flags"""))
def ellenberg_groups(spark, sf_dir):
    """C4 + P12: half-open sociology ranges -> grassland group."""
    return P.species_traits(spark, sf_dir).select("name", "sociology", "targetEllenberg")


_ABB_SQL = ("regexp_replace(concat(coalesce(substr(string_split(latin, '_')[1], 1, 4), 'NA'), "
            "coalesce(substr(string_split(latin, '_')[2], 1, 4), 'NA'), "
            "coalesce(substr(string_split(latin, '_')[4], 1, 4), 'NA')), 'NA', '')")


@register("species_abbrev", O.with_views(["v_traits"], f"""
select name, latin, {_ABB_SQL} as abb from v_traits"""))
def species_abbrev(spark, sf_dir):
    """4+4+4 letter abbreviation of the species name."""
    from sward.operators.traits import species_abbrev as abbrev
    from sward.sources import standin
    return abbrev(standin.traits(spark, sf_dir).select("name", "latin"))


@register("abbrev_duplicates", O.with_views(["v_traits"], f"""
select name, latin, abb from (
 select name, latin, abb, row_number() over (partition by abb order by latin, name) as rn
 from (select name, latin, {_ABB_SQL} as abb from v_traits) a) d
where rn > 1"""))
def abbrev_duplicates(spark, sf_dir):
    """Second and later species (in name order) sharing an abbreviation."""
    from sward.operators.traits import abbrev_duplicates as dups
    from sward.operators.traits import species_abbrev as abbrev
    from sward.sources import standin
    return dups(abbrev(standin.traits(spark, sf_dir).select("name", "latin")))


@register("location_labels", O.with_views(["v_plots"], """
select plot, location, upper(substr(location, 1, 3)) as locationAbb, constructionYear,
 concat(upper(substr(location, 1, 3)), '-', cast(constructionYear as varchar)) as locationYear
from v_plots"""))
def location_labels(spark, sf_dir):
    """F8: location abbreviation and location-year label per plot."""
    from sward.functions.rsem import str_sub
    from sward.sources import standin
    p = standin.plots(spark, sf_dir)
    return p.select("plot", "location", F.upper(str_sub("location", 1, 3)).alias("locationAbb"),
                    "constructionYear",
                    P.location_year(F.col("location"), F.col("constructionYear")).alias("locationYear"))


@register("location_levels", O.with_views(["v_plots"], """
select location, min(constructionYear) as firstConstructionYear,
 cast(row_number() over (order by min(cast(constructionYear as bigint) * 1000000000 + plot_key)) as integer) as level
from v_plots group by location"""))
def location_levels(spark, sf_dir):
    """Factor levels in order of first appearance after a stable sort by construction year.

    One partial aggregate per value gives its first appearance; the levels are
    numbered with the range-partitioned ``row_sequence`` (no single-task window).
    """
    from sward.operators.sequence import row_sequence
    from sward.sources import standin
    p = standin.plots(spark, sf_dir)
    first = (p.groupBy("location").agg(F.min(F.struct("constructionYear", "plot_key")).alias("_f"))
             .select("location", F.col("_f.constructionYear").alias("firstConstructionYear"),
                     F.col("_f.plot_key").alias("_first_key")))
    levels = row_sequence(first, ["firstConstructionYear", "_first_key"], "level")
    return levels.select("location", "firstConstructionYear", F.col("level").cast("int").alias("level"))


@register("factor_codes", """
with r as (select *, row_number() over () as pos from orders),
p as (select o_orderpriority as v, row_number() over (order by min(pos)) as code from r where o_orderpriority is not null group by 1),
s as (select o_orderstatus as v, row_number() over (order by min(pos)) as code from r where o_orderstatus is not null group by 1),
c as (select o_custkey as v, row_number() over (order by min(pos)) as code from r where o_custkey is not null group by 1)
select o_orderkey, o_orderpriority, o_orderstatus, o_custkey, cast(p.code as integer) as o_orderpriority_code,
 cast(s.code as integer) as o_orderstatus_code, cast(c.code as integer) as o_custkey_code
from r left join p on p.v = o_orderpriority left join s on s.v = o_orderstatus left join c on c.v = o_custkey""")
def factor_codes(spark, sf_dir):
    """W4 + W5: factor columns with codes by first appearance in the files (few levels and very many)."""
    from sward.operators.factors import encode_factors, with_position
    rows = with_position(spark, f"{sf_dir.rstrip('/')}/orders.parquet", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"])
    return encode_factors(rows, ["o_orderpriority", "o_orderstatus", "o_custkey"])


# --------------------------------------------------------------- species list checks
_PRESENT_SQL = "select name, sum(q) / 25e0 as total from v_cover group by name having sum(q) / 25e0 > 0"


@register("species_present", O.with_views(["v_cover"], f"""
select name, total, cast(1 as integer) as presence from ({_PRESENT_SQL}) t"""))
def species_present(spark, sf_dir):
    """A22 + F16: total cover per species over all visits, species with total > 0."""
    from sward.operators.species import species_present as present
    from sward.sources import standin
    return present(standin.cover(spark, sf_dir), value="q", scale=standin.COVER_SCALE)


@register("traits_semi", O.with_views(["v_cover", "v_flags"], f"""
select name, latin, family, leanIndicator, target from v_flags
where name in (select name from ({_PRESENT_SQL}) t)"""))
def traits_semi(spark, sf_dir):
    """Traits of the species that occur."""
    from sward.operators.species import species_present as present
    from sward.operators.traits import traits_of_present
    from sward.sources import standin
    pres = present(standin.cover(spark, sf_dir), value="q", scale=standin.COVER_SCALE)
    tr = P.species_traits(spark, sf_dir).select("name", "latin", "family", "leanIndicator", "target")
    return traits_of_present(tr, pres)


@register("species_without_traits", O.with_views(["v_cover", "v_traits"], f"""
select name, total from ({_PRESENT_SQL}) t where name not in (select name from v_traits)"""))
def species_without_traits(spark, sf_dir):
    """Occurring species that have no trait record."""
    from sward.operators.species import species_present as present
    from sward.operators.traits import species_without_traits as missing
    from sward.sources import standin
    pres = present(standin.cover(spark, sf_dir), value="q", scale=standin.COVER_SCALE).select("name", "total")
    return missing(pres, standin.traits(spark, sf_dir))


@register("species_frequency", O.with_views(["v_cover"], """
select name, count(case when q <> 0 then 1 end) as frequency from v_cover group by name"""))
def species_frequency(spark, sf_dir):
    """Number of visits in which each species occurs."""
    from sward.operators.species import species_frequency as freq
    from sward.sources import standin
    return freq(standin.cover(spark, sf_dir), value="q")


# --------------------------------------------------------------- ratios, sequence, group size
@register("site_ratios", O.with_views(["v_points", "v_plots"], f"""
select t.id, t.plot, t.surveyYear,
 {O.sql_r_round("t.targetCov / nullif(t.accumulatedCov, 0)", 3)} as targetCovratio,
 {O.sql_r_round("t.graminoidCov / nullif(t.accumulatedCov, 0)", 3)} as graminoidCovratio,
 {O.sql_r_round("cast(t.targetRichness as double) / nullif(t.speciesRichness, 0)", 3)} as targetRichratio,
 round(p.finematerialDepth * p.finematerialDensity * 10e0 * p.NtotalPerc / 100e0, 6) as NtotalConc,
 cast(t.surveyYear - p.constructionYear as integer) as plotAge
from v_points t left join v_plots p on t.plot_key = p.plot_key"""))
def site_ratios(spark, sf_dir):
    """Cover and richness ratios (R-rounded to 3 digits), N concentration, plot age."""
    from sward.functions.rsem import r_round_sql
    s = P.sites(spark, sf_dir)
    return s.selectExpr(*KEYS, *[f"{r_round_sql(c, 3)} AS {c}"
                                 for c in ("targetCovratio", "graminoidCovratio", "targetRichratio")],
                        "round(finematerialDepth * finematerialDensity * 10.0D * NtotalPerc / 100.0D, 6) AS NtotalConc",
                        "CAST(plotAge AS INT) AS plotAge")


@register("visit_sequence", O.with_views(["v_visits"], """
select id, row_number() over (order by id) as seq from v_visits"""))
def visit_sequence(spark, sf_dir):
    """W2 ``seq_along(id)``: 1..N in id order, range-partitioned (no single-task window)."""
    from sward.operators.sequence import row_sequence
    from sward.sources import standin
    from sward.sources.tables import table
    li = table(spark, sf_dir, "lineitem")
    visits = (li.select(F.col("l_suppkey").alias("plot_key"), F.year("l_shipdate").alias("surveyYear")).distinct()
              .select(standin.visit_id("plot_key", "surveyYear").alias("id")))
    return row_sequence(visits, ["id"], "seq")


@register("group_size", O.with_views(["v_points"], """
select id, plot, surveyYear, ffh, count(*) over (partition by plot) as count from v_points"""))
def group_size(spark, sf_dir):
    """A24 + A25 as written (the in-group max filter keeps every row)."""
    from sward.operators.change import group_size as gs
    return gs(P.visit_types(spark, sf_dir).select(*KEYS, "ffh"))


@register("complete_plots", O.with_views(["v_points"], """
select id, plot, surveyYear, n as count from v_points join
 (select plot, count(*) as n from v_points group by plot) c using (plot)
where n = (select max(n) from (select plot, count(*) as n from v_points group by plot) m)"""))
def complete_plots(spark, sf_dir):
    """A25, evident intent: plots with as many visits as the most visited plot."""
    from sward.operators.change import complete_plots as cp
    return cp(P.visit_types(spark, sf_dir).select(*KEYS))


# --------------------------------------------------------------- map layers
@register("first_visit", O.with_views(["v_site"], """
select plot, surveyYear, id, location, exposition, side from (
 select *, row_number() over (partition by plot order by surveyYear, id) as rn from v_site) f where rn = 1"""))
def first_visit(spark, sf_dir):
    """The first visit row of every plot (file order = year, id)."""
    from sward.operators.mapview import first_visit as fv
    return fv(P.analysis_table(spark, sf_dir))


def _plot_layer_sql() -> str:
    disp = "cast(cast(p.plot as bigint) as varchar)"
    popup = (f"concat('<b>', {_na(_esc_sql('f.location'))}, '</b>', '<br/>', 'ID: ', {_na(_esc_sql(disp))}, "
             f"'</b>', '<br/>', 'Exposition: ', {_na(_esc_sql('f.exposition'))}, '</b>', '<br/>', "
             f"'Seite: ', {_na(_esc_sql('f.side'))})")
    label = f"concat({_na('f.location')}, ' (ID: ', {_na(disp)}, ')')"
    return O.with_views(["v_site", "v_plots"], f"""
select p.plot, p.lon, p.lat, f.location, f.exposition, f.side, {disp} as plot_display,
 {popup} as popup, {label} as label
from v_plots p left join (
 select * from (select *, row_number() over (partition by plot order by surveyYear, id) as rn from v_site) x
 where rn = 1) f on p.plot = f.plot""")


@register("plot_layer", _plot_layer_sql())
def plot_layer(spark, sf_dir):
    """M1 + J1 + S5 + F9 + F10: marker layer with first-visit attributes, popup and label."""
    from sward.operators.mapview import plot_layer as layer
    from sward.sources.layers import point_layer
    return layer(point_layer(spark, sf_dir), P.analysis_table(spark, sf_dir))


def _line_layer_sql() -> str:
    built, ren = _na(_esc_sql("BAUJAHR")), _na(_esc_sql("SANIERUNG"))
    return O.with_views(["v_vertices"], f"""
select line_id, BAUJAHR, SANIERUNG, GWO_L, BETREIBE_L, n_vertices,
 concat('Baujahr: ', {built}, ', Sanierung:', {ren}) as label,
 concat('Baujahr: ', {built}, '<br/>', 'Sanierung: ', {ren}) as popup
from (select o_orderkey as line_id, cast(year(o_orderdate) as varchar) as BAUJAHR,
             case when o_orderstatus = 'P' then null
                  else concat('<', o_orderstatus, '> & ', o_orderpriority) end as SANIERUNG,
             o_orderstatus as GWO_L, o_orderpriority as BETREIBE_L
      from orders) a
left join (select line_id, count(*) as n_vertices from v_vertices group by line_id) c using (line_id)""")


@register("line_layer", _line_layer_sql())
def line_layer(spark, sf_dir):
    """M2 + S6 + F10: line attributes, vertex count, label and popup."""
    from sward.operators.mapview import line_layer as layer
    from sward.sources.layers import line_layer_with_vertices
    return layer(line_layer_with_vertices(spark, sf_dir))


@register("line_geometry", O.with_views(["v_vertices"], f"""
select o_orderkey as line_id, cast(year(o_orderdate) as varchar) as BAUJAHR,
 case when o_orderstatus = 'P' then null else concat('<', o_orderstatus, '> & ', o_orderpriority) end as SANIERUNG,
 o_orderstatus as GWO_L, concat('1', printf('%02d', o_custkey % 100)) as L_GEW_KNZ, n_name as LKR_L, c_name as GEM_L,
 r_name as WWA_L, o_orderpriority as BETREIBE_L, case when o_custkey % 2 = 0 then 'links' else 'rechts' end as LAGE_FLI_L,
 part, piece, n_vertices, wkt
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey
left join region on r_regionkey = n_regionkey
left join (
 select line_id, part, piece, count(*) as n_vertices,
  concat(case when count(*) > 1 then 'LINESTRING (' else 'POINT (' end,
         string_agg(concat(cast(cast(lon as decimal(12,6)) as varchar), ' ', cast(cast(lat as decimal(12,6)) as varchar)), ', ' order by i), ')') as wkt
 from (select line_id, part, i, lon, lat, unnest(case when i % {GEOMETRY_PIECE} = 0 and i > 0
               then [i // {GEOMETRY_PIECE}, i // {GEOMETRY_PIECE} - 1] else [i // {GEOMETRY_PIECE}] end) as piece
       from (select *, row_number() over (partition by line_id, part order by s1, s2, s3) - 1 as i
             from (select *, cast((s1 - 1) // 3 as integer) as part from v_vertices) a) b) c
 group by line_id, part, piece having count(*) > 1 or piece = 0) g on g.line_id = o_orderkey"""))
def line_geometry(spark, sf_dir):
    """S6 + M2: all nine attributes of every line with the geometry of its parts as WKT."""
    from sward.operators.geo import line_pieces
    from sward.sources.layers import line_attributes_full, part_vertices
    pieces = line_pieces(part_vertices(spark, sf_dir), "line_id", "part", ["s1", "s2", "s3"], piece=GEOMETRY_PIECE, distinct=True)
    return line_attributes_full(spark, sf_dir).join(pieces, "line_id", "left")


# --------------------------------------------------------------- series and reference lines
def _series_sql(metric: str, lo: float, hi: float, extra: str = "") -> str:
    return O.with_views(["v_site", "v_plots"], f"""
select location, plot, surveyYear, {metric} as y, biotopeType,
 ({metric} >= {lo} and {metric} <= {hi}) as in_range,
 concat({_na(_esc_sql('location'))}, '. ID: ', {_na(_esc_sql('plot'))}) as title {extra}
from v_site where plot in (select plot from v_plots)""")


def _all_plots(spark, sf_dir):
    from sward.sources.layers import point_layer
    return point_layer(spark, sf_dir).select("plot")


@register("plot_series", _series_sql("speciesRichness", 0, 50))
def plot_series(spark, sf_dir):
    """M3 + P10: species-richness series of the plots on the map (semi join on the point layer)."""
    from sward.operators.mapview import plot_series as series
    return series(P.analysis_table(spark, sf_dir), "speciesRichness", _all_plots(spark, sf_dir))


@register("plot_selection", _series_sql("rlgRichness", 0, 8))
def plot_selection(spark, sf_dir):
    """P15 default branch: an unknown metric name selects rlgRichness."""
    from sward.operators.mapview import plot_series as series
    return series(P.analysis_table(spark, sf_dir), "anything-else", _all_plots(spark, sf_dir))


def _stats_sql(metrics) -> str:
    parts = []
    for m in metrics:
        parts.append(f"""select '{m}' as metric,
 round(case when count({m}) = count(*) then avg({m}) end, 6) as mean,
 round(case when count({m}) = count(*) then avg({m}) + 0.5e0 * stddev_samp({m}) end, 6) as upper,
 round(case when count({m}) = count(*) then avg({m}) - 0.5e0 * stddev_samp({m}) end, 6) as lower,
 min(surveyYear) as x_min, max(surveyYear) as x_max from v_site""")
    return " union all ".join(parts)


_METRICS = ("speciesRichness", "biotopePoints", "rlgRichness")


def _round_stats(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("mean", "upper", "lower") else F.col(c)
                       for c in df.columns])


@register("reference_lines", O.with_views(["v_site"], _stats_sql(_METRICS)))
def reference_lines(spark, sf_dir):
    """M4 (A26 + A27): global mean, mean +- 0.5 sd and year domain for each metric, one pass."""
    from sward.operators.mapview import reference_stats_all
    return _round_stats(reference_stats_all(P.analysis_table(spark, sf_dir), _METRICS))


@register("series_with_bands", _series_sql("biotopePoints", 0, 15, """,
 case when biotopePoints >= 0 and biotopePoints <= 8.5 then 'red'
      when biotopePoints > 8.5 and biotopePoints <= 11.5 then 'green'
      when biotopePoints > 11.5 and biotopePoints <= 15 then 'green3' end as band"""))
def series_with_bands(spark, sf_dir):
    """M5 + C23: biotope-points series with the chart band per point."""
    from sward.operators.mapview import series_with_bands as bands
    return bands(P.analysis_table(spark, sf_dir), _all_plots(spark, sf_dir))


@register("series_all_plots", O.with_views(["v_site", "v_plots"], """
select location, plot, surveyYear, speciesRichness as y, biotopeType,
 (speciesRichness >= 0 and speciesRichness <= 50) as in_range,
 concat(coalesce(replace(replace(replace(location, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 'NA'), '. ID: ',
        coalesce(replace(replace(replace(plot, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 'NA')) as title,
 s.mean, s.upper, s.lower, s.x_min, s.x_max
from v_site join s on s.metric = 'speciesRichness' where plot in (select plot from v_plots)""",
    extra=[("s", _stats_sql(["speciesRichness"]))]))
def series_all_plots(spark, sf_dir):
    """M6 + J8: every plot's series with the global reference lines attached."""
    from sward.operators.mapview import series_with_reference
    return _round_stats(series_with_reference(P.analysis_table(spark, sf_dir), "speciesRichness",
                                              _all_plots(spark, sf_dir)))


@register("stored_series", O.with_views(["v_site", "v_plots"], f"""
select location, plot, surveyYear, speciesRichness as y, biotopeType,
 (speciesRichness >= 0 and speciesRichness <= 50) as in_range,
 concat({_na(_esc_sql('location'))}, '. ID: ', {_na(_esc_sql('plot'))}) as title,
 cast(row_number() over (partition by plot order by surveyYear) as integer) as seq
from v_site where plot in (select plot from v_plots where location = 'NATION_18')"""))
def stored_series(spark, sf_dir):
    """P10 + M3 + W6: the plots of one location, from the stored analysis table (only their folders are read), in year order."""
    from sward.plans.stored import stored_series as series
    from sward.plans.stored import write_stored
    from sward.session import shared_path
    from sward.sources import standin
    path = write_stored(P.site_table(spark, sf_dir), shared_path(spark, "analysis-table"))
    clicked = standin.plots(spark, sf_dir).where(F.col("location") == "NATION_18").select("plot")
    return series(spark, path, "speciesRichness", clicked)


# --------------------------------------------------------------- geo
@register("location_centroid", O.with_views(["v_plots"], """
select concat(upper(substr(location, 1, 3)), '-', cast(constructionYear as varchar)) as locationYear,
 round(avg(lon), 6) as longitude_center, round(avg(lat), 6) as latitude_center, count(*) as n_plots
from v_plots group by 1"""))
def location_centroid(spark, sf_dir):
    """Centroid of the plots of each location-year."""
    from sward.operators.geo import centroids
    from sward.sources import standin
    p = standin.plots(spark, sf_dir).withColumn(
        "locationYear", P.location_year(F.col("location"), F.col("constructionYear")))
    c = centroids(p, "locationYear")
    return c.select("locationYear", F.round("longitude_center", 6).alias("longitude_center"),
                    F.round("latitude_center", 6).alias("latitude_center"), "n_plots")


@register("path_length", O.with_views(["v_vertices"], """
select line_id, round(sum(2 * 6371.0088e0 * asin(sqrt(power(sin(radians(lat - plat) / 2), 2)
 + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2)))), 6) as km
from (select line_id, lon, lat, lag(lon) over w as plon, lag(lat) over w as plat from v_vertices
      window w as (partition by line_id order by s1, s2, s3)) e
where plon is not null group by line_id"""))
def path_length(spark, sf_dir):
    """M7: great-circle length of every line (skew-safe consecutive pairs)."""
    from sward.operators.geo import path_lengths
    from sward.sources import standin
    r = path_lengths(standin.vertices(spark, sf_dir, distinct=False), "line_id", ["s1", "s2", "s3"],
                     distinct=True)
    return r.select("line_id", F.round("km", 6).alias("km"))


@register("ring_area", O.with_views(["v_vertices"], """
select line_id, round(abs(sum(radians(nlon - lon) * (2 + sin(radians(lat)) + sin(radians(nlat)))))
 * 6371.0088e0 * 6371.0088e0 / 2, 4) as km2
from (select line_id, lon, lat, coalesce(lead(lon) over w, first_value(lon) over w) as nlon,
             coalesce(lead(lat) over w, first_value(lat) over w) as nlat from v_vertices
      window w as (partition by line_id order by s1, s2, s3)) e
group by line_id having count(*) >= 3"""))
def ring_area(spark, sf_dir):
    """M8: spherical area of every ring with at least three vertices."""
    from sward.operators.geo import ring_areas
    from sward.sources import standin
    r = ring_areas(standin.vertices(spark, sf_dir, distinct=False), "line_id", ["s1", "s2", "s3"],
                   distinct=True)
    return r.select("line_id", F.round("km2", 4).alias("km2"))


# --------------------------------------------------------------- reshape
_SHEET_MEASURES = ("vegetationCov", "vegetationHeight", "opensoilCov", "mossCov", "litterCov", "botanist")
# every plot in every survey year of the data
_SHEET_SQL = """
select printf('%05d', p.k) as plot, y.surveyYear, vegetationCov, vegetationHeight, coalesce(opensoilCov, 0e0) as opensoilCov,
 mossCov, coalesce(litterCov, 0e0) as litterCov, botanist
from (select distinct l_suppkey as k from lineitem) p
cross join (select distinct cast(year(l_shipdate) as integer) as surveyYear from lineitem) y
left join (select l_suppkey as k, cast(year(l_shipdate) as integer) as surveyYear, sum(l_quantity) / 25e0 as vegetationCov,
            max(l_quantity) as vegetationHeight, cast(count(case when l_returnflag = 'R' then 1 end) as double) as opensoilCov,
            min(l_quantity) as mossCov, cast(count(*) as double) / 4e0 as litterCov, min(l_linestatus) as botanist
           from lineitem group by 1, 2) a using (k, surveyYear)"""


@register("unpivot_measures", O.with_views([], " union all ".join(
    f"select plot, '{m}' as x, cast(surveyYear as varchar) as surveyYear, cast({m} as varchar) as n from sheet" for m in _SHEET_MEASURES),
    extra=[("sheet", _SHEET_SQL)]))
def unpivot_measures(spark, sf_dir):
    """R1 + P3 + P4 + P5 + P8: measure-year columns of the plot sheet -> (plot, measure, year, value as text)."""
    from sward.operators.reshape import columns_matching, relocate, require_columns
    from sward.operators.reshape import unpivot_measures as unpivot
    from sward.sources.layers import plot_sheet
    sheet = plot_sheet(spark, sf_dir)
    found = columns_matching(sheet, prefixes=[m + "_" for m in _SHEET_MEASURES])
    sheet = require_columns(sheet, ["plot", *found])
    numbers = columns_matching(sheet, numeric=True)
    return unpivot(relocate(sheet, numbers, after="plot"), ["plot"], _SHEET_MEASURES)


@register("pivot_measures", O.with_views([], "select * from sheet", extra=[("sheet", _SHEET_SQL)]))
def pivot_measures(spark, sf_dir):
    """R2 + R3: one row per (plot, year) with typed measure columns (narrow explode, no shuffle)."""
    from sward.operators.reshape import wide_to_visits
    from sward.sources.layers import SHEET_NUMERIC, plot_sheet
    return wide_to_visits(plot_sheet(spark, sf_dir), ["plot"], _SHEET_MEASURES, numeric=SHEET_NUMERIC)


_GRAM = "('Poaceae','Cyperaceae','Juncaceae')"


@register("spread_types", O.with_views(["v_cover", "v_traits"], f"""
select concat('X', printf('%05d', plot_key), '_m_', cast(surveyYear as varchar)) as id,
 sum(case when family in {_GRAM} then q end) / 25e0 as graminoidCov,
 sum(case when family not in {_GRAM} then q end) / 25e0 as herbCov
from v_cover left join v_traits using (name) group by plot_key, surveyYear"""))
def spread_types(spark, sf_dir):
    """A1 two-level form + R6: per (visit, type) sums spread to columns; a missing type stays NULL."""
    from sward.operators.metrics import GRAMINOID_FAMILIES
    from sward.operators.reshape import spread_sum
    from sward.sources import standin
    fam = F.col("family")
    typed = (standin.cover(spark, sf_dir)
             .join(standin.traits(spark, sf_dir).select("name", "family"), "name", "left")
             .withColumn("type", r_if(fam.isin(*GRAMINOID_FAMILIES), "graminoidCov", "herbCov")))
    wide = spread_sum(typed, ["plot_key", "surveyYear"], "type", ["graminoidCov", "herbCov"], "q",
                      standin.COVER_SCALE)
    return wide.select(standin.visit_id("plot_key", "surveyYear").alias("id"), "graminoidCov", "herbCov")


@register("cover_long", O.with_views(["v_cover", "v_flags"], """
select concat('X', printf('%05d', plot_key), '_m_', cast(surveyYear as varchar)) as id,
 name, q / 25e0 as n, family, target, targetHerb from v_cover left join v_flags using (name)"""))
def cover_long(spark, sf_dir):
    """R4 + J2 + P1 P2 P6 P7: long cover table joined to the species traits."""
    from sward.sources import standin
    tr = P.species_traits(spark, sf_dir).select("name", "family", "target", "targetHerb", "latin")
    c = (standin.cover(spark, sf_dir).join(tr, "name", "left")
         .withColumnsRenamed({"q": "n_raw"})
         .withColumns({"n": F.col("n_raw") / F.lit(standin.COVER_SCALE),
                       "id": standin.visit_id("plot_key", "surveyYear")})
         .drop("n_raw", "latin"))
    return c.select("id", "name", "n", "family", "target", "targetHerb")


@register("cover_matrix", ORACLE["cover_long"])
def cover_matrix(spark, sf_dir):
    """R4 + P4 + S3: species x visit sheets written as text, read by header, unpivoted for the visits of the survey, joined to traits."""
    from sward.session import shared_path
    from sward.sources import standin
    from sward.sources.matrix import read_matrix, write_matrix
    from sward.sources.tables import table
    # a sheet: one survey year and 32 neighbouring plots
    year, plot = F.col("surveyYear"), F.col("plot_key")
    cover = standin.cover(spark, sf_dir).select(
        (F.floor(plot / 32) * 10000 + year).cast("long").alias("sheet"), "name", standin.visit_id("plot_key", "surveyYear").alias("id"),
        (F.col("q") / F.lit(standin.COVER_SCALE)).alias("n"))
    path = write_matrix(cover, shared_path(spark, "cover-matrix"))
    visits = (table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("plot_key"), F.year("l_shipdate").alias("surveyYear"))
              .distinct().select(standin.visit_id("plot_key", "surveyYear").alias("id")))
    long = read_matrix(spark, path, visits=visits).withColumn("name", F.col("name").cast("long"))
    tr = P.species_traits(spark, sf_dir).select("name", "family", "target", "targetHerb")
    return long.join(tr, "name", "left").select("id", "name", "n", "family", "target", "targetHerb")


_FAMILIES = ("Poaceae", "Cyperaceae", "Juncaceae", "Fabaceae", "Asteraceae", "Rosaceae")


@register("cover_wide", O.with_views(["v_cover", "v_traits"], """
select concat('X', printf('%05d', plot_key), '_m_', cast(surveyYear as varchar)) as id, """
    + ", ".join(f"sum(case when family = '{f}' then q end) / 25e0 as {f}" for f in _FAMILIES) + """
from v_cover left join v_traits using (name) group by plot_key, surveyYear"""))
def cover_wide(spark, sf_dir):
    """Visit x family cover matrix (explicit pivot values: no extra job, bounded width)."""
    from sward.operators.reshape import spread_sum
    from sward.sources import standin
    c = (standin.cover(spark, sf_dir)
         .join(standin.traits(spark, sf_dir).select("name", "family"), "name", "left"))
    wide = spread_sum(c, ["plot_key", "surveyYear"], "family", _FAMILIES, "q", standin.COVER_SCALE)
    return wide.select(standin.visit_id("plot_key", "surveyYear").alias("id"), *_FAMILIES)


@register("visit_vectors", O.with_views(["v_cover", "v_visits"], """
select id, n_species, total, first_species, last_species, round(shannon, 6) as shannon
from (select plot_key, surveyYear, cast(count(*) as integer) as n_species, sum(q) / 25e0 as total, min(name) as first_species,
             max(name) as last_species from v_cover where q <> 0 group by 1, 2) c join v_visits using (plot_key, surveyYear)"""))
def visit_vectors(spark, sf_dir):
    """R5 + A21: visits as sparse species vectors; species range, total and Shannon's H come from the vectors."""
    from sward.operators.vectors import vector_summary
    from sward.operators.vectors import visit_vectors as vectors
    from sward.sources import standin
    keys = ["plot_key", "surveyYear"]
    out = vector_summary(vectors(standin.cover(spark, sf_dir), keys, value="q"), keys, scale=standin.COVER_SCALE)
    return out.select(standin.visit_id("plot_key", "surveyYear").alias("id"), "n_species", "total", "first_species", "last_species",
                      F.round("shannon", 6).alias("shannon"))


# --------------------------------------------------------------- CSV ingest and sinks
@register("csv_null_tokens", """
select o_orderkey,
 case when o_orderstatus in ('F', 'P') then null else o_orderstatus end as status,
 case when o_orderkey % 10 in (0, 1) then null else o_totalprice end as price,
 case when o_orderkey % 10 in (0, 1) then 0e0 else o_totalprice end as price0,
 (o_orderkey % 10 in (0, 1)) as price_missing,
 case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) end as orderdate,
 case when o_orderkey % 5 = 0 then null else o_orderpriority end as priority
from orders""")
def csv_null_tokens(spark, sf_dir):
    """Write orders as CSV text with NA tokens and bad numbers, read it back typed."""
    from sward.functions.rsem import fill_zero
    from sward.session import shared_path
    from sward.sources.csv import read_typed_csv, write_csv
    from sward.sources.tables import table
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = o.select(
        k.cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderstatus") == "F", "na").when(F.col("o_orderstatus") == "P", "NA")
         .otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 10 == 0, F.concat(F.lit("x"), F.col("o_totalprice").cast("string")))
         .when(k % 10 == 1, F.lit(""))
         .otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 7 == 0, "NA").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("orderdate"),
        F.when(k % 5 == 0, "na").otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    path = write_csv(text, shared_path(spark, "csv-null-tokens"))
    typed = read_typed_csv(spark, path, {"o_orderkey": "bigint", "status": "string", "price": "double",
                                         "orderdate": "date:yyyy-MM-dd", "priority": "string"}, uniform=True)
    typed = typed.withColumns({"price_missing": F.col("price").isNull(), "price0": F.col("price")})
    typed = fill_zero(typed, ["price0"])
    return typed.select("o_orderkey", "status", "price", "price0", "price_missing", "orderdate", "priority")


@register("csv_app_tokens", O.with_views(["v_site"], """
select * replace (case when riverkm % 5 = 0 then '' else side end as side,
                  case when riverkm % 7 = 0 then null when riverkm % 3 = 0 then '' else botanist end as botanist) from v_site"""))
def csv_app_tokens(spark, sf_dir):
    """The dashboard's reader; na and NA are NULL, an empty field is empty text."""
    from sward.session import shared_path
    from sward.sources.csv import write_csv
    k = F.col("riverkm")
    t = P.site_table(spark, sf_dir).withColumns({
        "side": F.when(k % 5 == 0, "").otherwise(F.col("side")),
        "botanist": F.when(k % 7 == 0, "na").when(k % 3 == 0, "").otherwise(F.col("botanist"))})
    return P.read_analysis_csv(spark, write_csv(t, shared_path(spark, "app-csv")))


@register("csv_delimited", """
select o_orderkey, case when o_orderkey % 6 = 0 then null else o_totalprice end as price,
 case when o_orderkey % 10 = 0 then null else o_orderstatus end as status, cast(o_orderdate as date) as orderdate from orders""")
def csv_delimited(spark, sf_dir):
    """A folder of ``;`` files with decimal commas, a line before the header, and columns in two orders."""
    from sward.session import shared_path
    from sward.sources.csv import read_typed_csv, write_line_files
    from sward.sources.tables import table
    o = table(spark, sf_dir, "orders")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = F.col("o_orderkey")
    price = F.when(k % 6 == 0, "na").otherwise(F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")))
    status = F.when(k % 10 == 0, "").otherwise(F.col("o_orderstatus"))
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    file = F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).cast("int")
    line = F.when(file % 2 == 0, F.concat_ws(";", k.cast("string"), price, status, day)).otherwise(F.concat_ws(";", day, status, k.cast("string"), price))
    heads = spark.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(F.lit(0), F.lit(1))).alias("at"))
    header = F.when(F.col("file") % 2 == 0, "o_orderkey;price;status;orderdate").otherwise("orderdate;status;o_orderkey;price")
    heads = heads.withColumn("value", F.when(F.col("at") == 0, "exported sheet; do not edit").otherwise(header))
    path = write_line_files(heads, o.select(file.alias("file"), line.alias("value")), shared_path(spark, "csv-delimited"))
    typed = read_typed_csv(spark, path, {"o_orderkey": "bigint", "price": "double", "status": "string", "orderdate": "date:dd.MM.yyyy"},
                           sep=";", dec=",", skip=1)
    return typed.select("o_orderkey", "price", "status", "orderdate")


@register("species_list_sink", O.with_views(["v_cover"], """
select cast(name as varchar) as name, cast(count(case when q <> 0 then 1 end) as bigint) as frequency
from v_cover group by name"""))
def species_list_sink(spark, sf_dir):
    """S8 + W6: species frequency list written sorted by name as CSV, read back."""
    from sward.operators.species import species_frequency as freq
    from sward.session import shared_path
    from sward.sources.csv import read_typed_csv, write_csv
    from sward.sources import standin
    lst = freq(standin.cover(spark, sf_dir), value="q").orderBy("name")
    path = write_csv(lst, shared_path(spark, "species-list"))
    return read_typed_csv(spark, path, {"name": "string", "frequency": "bigint"}, uniform=True)



@register("species_list_sorted", O.with_views(["v_cover"], """
select name, count(case when q <> 0 then 1 end) as frequency, row_number() over (order by name) as position
from v_cover group by name"""))
def species_list_sorted(spark, sf_dir):
    """S8 + W6: the species list written in total order, read back with every row's position."""
    from sward.operators.species import species_frequency as freq
    from sward.session import shared_path
    from sward.sources import standin
    from sward.sources.ordered import read_sorted, write_sorted
    path = write_sorted(freq(standin.cover(spark, sf_dir), value="q"), shared_path(spark, "species-sorted"), "name")
    return read_sorted(spark, path).select("name", "frequency", "position")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
