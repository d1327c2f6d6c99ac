"""DuckDB SQL for every catalogue query (the correctness oracle).

The stand-in views are written once as CTE texts and stitched in front of each
query body.  They are the oracle's form of the rules - plain CASE chains - not
the engine's implementation.  Doubles that come from non-exact arithmetic are
rounded to 6 digits on both sides.
"""

from __future__ import annotations


def sql_r_round(expr: str, digits: int) -> str:
    """R >= 4 rounding written in SQL with the same IEEE operations as ``r_round``."""
    p = f"{float(10 ** digits)!r}e0" if "e" not in repr(float(10 ** digits)) else repr(float(10 ** digits))
    ax = f"abs(({expr}))"
    lo_i = f"floor({ax} * {p})"
    lo = f"({lo_i} / {p})"
    hi = f"(ceil({ax} * {p}) / {p})"
    pick = (f"case when ({hi} - {ax}) < ({ax} - {lo}) then {hi} "
            f"when ({ax} - {lo}) < ({hi} - {ax}) then {lo} "
            f"when cast({lo_i} as bigint) % 2 = 1 then {hi} else {lo} end")
    return (f"(case when ({expr}) is null then null when {ax} * {p} >= 1e15 then ({expr}) "
            f"else sign(({expr})) * ({pick}) end)")


VIEWS: dict[str, str] = {}

VIEWS["v_plots"] = """
select s_suppkey as plot_key, printf('%05d', s_suppkey) as plot, n_name as location,
 cast(n_regionkey as integer) as block, r_name as blockRegion,
 case s_suppkey % 4 when 0 then 'south' when 1 then 'north' when 2 then 'east' else 'west' end as exposition,
 case when s_suppkey % 2 = 0 then 'water' else 'land' end as side,
 cast(1990 + n_nationkey % 12 as integer) as constructionYear,
 cast(2280 + (s_suppkey * 7) % 50 as integer) as riverkm,
 s_acctbal / 10e0 as distanceRiver,
 12e0 + (s_suppkey % 97) / 100e0 as lon, 48e0 + (s_suppkey % 89) / 100e0 as lat,
 cast(5 + s_suppkey % 20 as double) as finematerialDepth, 1e0 + (s_suppkey % 7) / 10e0 as finematerialDensity,
 (s_suppkey % 13) / 100e0 as NtotalPerc
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

VIEWS["v_cover"] = """
select l_suppkey as plot_key, cast(year(l_shipdate) as integer) as surveyYear, l_partkey as name,
 sum(l_quantity) as q
from lineitem group by l_suppkey, year(l_shipdate), l_partkey
"""

VIEWS["v_traits"] = """
select p_partkey as name,
 concat(replace(p_name, ' ', '_'), case when p_size % 5 = 0 then concat('_ssp_', lower(p_type)) else '' end) as latin,
 case p_type when 'SMALL' then 'Poaceae' when 'MEDIUM' then 'Cyperaceae' when 'LARGE' then 'Fabaceae'
  when 'ECONOMY' then 'Asteraceae' when 'STANDARD' then 'Rosaceae' end as family,
 cast(case when p_size < 50 then 3000 + p_size * 65 end as double) as sociology,
 case when p_size % 3 = 0 then 'yes' when p_size % 3 = 1 then 'no' end as targetHerb,
 case when p_size % 11 = 0 then 'yes' else 'no' end as targetGrass,
 case when p_brand = 'Brand#7' then 'yes' else 'no' end as targetArrhenatherion,
 case when p_size % 4 = 1 then 'yes' else 'no' end as nitrogenIndicator,
 case when p_size % 7 = 2 then 'yes' else 'no' end as ruderalIndicator,
 case when p_size % 6 = 0 then 'yes' else 'no' end as ffh6510,
 case when p_size % 9 = 0 then 'yes' else 'no' end as ffh6210,
 case p_brand when 'Brand#1' then '1' when 'Brand#2' then '2' when 'Brand#3' then '3' when 'Brand#4' then 'V'
  when 'Brand#6' then '*' end as rlg,
 case p_brand when 'Brand#8' then '1' when 'Brand#9' then '2' when 'Brand#10' then '3' when 'Brand#14' then 'V' end as rlb,
 case when p_brand = 'Brand#5' then '1' end as table30,
 case p_size % 10 when 1 then '2' when 3 then '3' when 5 then '4' end as table33,
 case p_brand when 'Brand#11' then '2' when 'Brand#13' then '3' end as table34
from part
"""

VIEWS["v_flags"] = """
select *,
 case when coalesce(table30, table33, table34) is not null then 'yes' else 'no' end as leanIndicator,
 case when (targetHerb = 'yes' or targetGrass = 'yes') then 'yes'
      when not (targetHerb = 'yes' or targetGrass = 'yes') then 'no' end as target,
 case when sociology >= 3300 and sociology < 3700 then 'yes' when not (sociology >= 3300 and sociology < 3700) then 'no' end as ruderal,
 case when sociology is null then null
      when sociology >= 5300 and sociology < 5400 then 'dry_grassland'
      when sociology >= 5400 and sociology < 6000 then 'hay_meadow'
      when sociology >= 5100 and sociology < 5200 then 'nardus_grassland'
      when sociology >= 5200 and sociology < 5300 then 'sand_grassland' else 'no' end as targetEllenberg
from v_traits
"""


def _cov(pred: str) -> str:
    return f"round(coalesce(sum(case when {pred} then q end), 0) / 25e0, 1)"


def _rich(pred: str) -> str:
    return f"cast(count(case when q > 0 and {pred} then 1 end) as integer)"


VIEWS["v_metrics"] = f"""
select plot_key, surveyYear,
 coalesce(sum(case when family in ('Poaceae','Cyperaceae','Juncaceae') then q end), 0) / 25e0 as graminoidCov,
 coalesce(sum(case when family not in ('Poaceae','Cyperaceae','Juncaceae') then q end), 0) / 25e0 as herbCov,
 {_cov("target = 'yes'")} as targetCov,
 {_cov("targetHerb = 'yes'")} as targetHerbCov,
 {_cov("targetArrhenatherion = 'yes'")} as arrhCov,
 {_cov("leanIndicator = 'yes'")} as leanCov,
 {_cov("nitrogenIndicator = 'yes'")} as nitrogenCov,
 {_cov("ruderalIndicator = 'yes'")} as ruderalCov,
 {_cov("table33 in ('2','3','4')")} as table33Cov,
 {_rich("true")} as speciesRichness,
 {_rich("rlg in ('1','2','3','V')")} as rlgRichness,
 {_rich("rlb in ('1','2','3','V')")} as rlbRichness,
 {_rich("target = 'yes'")} as targetRichness,
 {_rich("targetHerb = 'yes'")} as targetHerbRichness,
 {_rich("targetArrhenatherion = 'yes'")} as arrhRichness,
 {_rich("ffh6510 = 'yes'")} as ffh6510Richness,
 {_rich("ffh6210 = 'yes'")} as ffh6210Richness,
 {_rich("leanIndicator = 'yes'")} as leanIndicatorRichness,
 {_rich("table33 = '2'")} as table33_2Richness,
 {_rich("table33 = '3'")} as table33_3Richness,
 {_rich("table33 = '4'")} as table33_4Richness,
 {_rich("table34 = '2'")} as table34_2Richness,
 {_rich("table34 = '3'")} as table34_3Richness,
 ln(sum(case when q > 0 then q end)) - sum(case when q > 0 then q * ln(q) end) / sum(case when q > 0 then q end) as shannon
from v_cover left join v_flags using (name)
group by plot_key, surveyYear
"""

VIEWS["v_visits"] = """
select *, concat('X', printf('%05d', plot_key), '_m_', cast(surveyYear as varchar)) as id,
 printf('%05d', plot_key) as plot, graminoidCov + herbCov as accumulatedCov
from v_metrics
"""

# biotope rules in the oracle's CASE form (first match wins)
VIEWS["v_types"] = """
select *, case
 when (table33_2Richness >= 2 or table33_2Richness + table33_3Richness >= 3
       or table33_2Richness + table33_3Richness + table33_4Richness >= 4)
      and table33Cov >= 25 and (table34_2Richness >= 2 or table34_2Richness + table34_3Richness >= 3) then 'G312-GT6210'
 when ge and arrhRichness >= 1 and arrhCov > 0.5 and leanCov >= 25 and targetHerbCov >= 12.5 then 'G214-GE6510'
 when ge and arrhRichness >= 1 and arrhCov > 0.5 and leanCov < 25 then 'G212-LR6510'
 when ge and leanCov >= 25 and targetHerbCov >= 12.5 and (arrhRichness = 0 or arrhCov >= 0.5) then 'G214-GE00BK'
 when ge and leanCov >= 25 and targetHerbCov < 12.5 and (arrhRichness = 0 or arrhCov >= 0.5) then 'G213-GE00BK'
 when leanCov >= 25 then 'G213'
 when leanCov >= 1 and leanCov < 25 and targetHerbCov >= 12.5 and targetHerbRichness >= 10 then 'G212'
 when leanCov >= 1 and leanCov < 25 and targetHerbCov >= 1 and targetHerbRichness >= 5 then 'G211'
 else 'other' end as biotopeType
from (select *, targetHerbCov >= 12.5 and targetRichness >= 20 and nitrogenCov < 25 as ge from v_visits) m
"""

VIEWS["v_points"] = """
select *,
 case when biotopeType like '%6510%' then '6510' when biotopeType like '%6210%' then '6210' else 'non-FFH' end as ffh,
 substr(biotopeType, 1, 4) as baykompv,
 cast(case biotopeType when 'G312-GT6210' then 13 when 'G214-GE6510' then 12 when 'G212-LR6510' then 9
  when 'G214-GE00BK' then 12 when 'G213-GE00BK' then 9 when 'G213' then 8 when 'G212' then 8 when 'G211' then 6
  else 0 end as integer) as biotopePoints
from v_types
"""

VIEWS["v_site"] = f"""
select t.id, t.plot, p.block, p.location,
 concat(upper(substr(p.location, 1, 3)), '-', cast(p.constructionYear as varchar)) as locationYear,
 p.riverkm, {sql_r_round("p.distanceRiver", 1)} as distanceRiver, t.surveyYear, p.exposition, p.side,
 {sql_r_round("t.accumulatedCov", 1)} as accumulatedCov, t.speciesRichness, t.rlgRichness, t.biotopeType, t.ffh,
 t.biotopePoints,
 case when (t.plot_key + t.surveyYear) % 7 = 0 then null
      else concat('botanist_', cast((t.plot_key + t.surveyYear) % 3 as varchar)) end as botanist
from v_points t left join v_plots p on t.plot_key = p.plot_key
where {sql_r_round("t.accumulatedCov", 1)} > 0
"""

VIEWS["v_vertices"] = """
select distinct l_orderkey as line_id, l_linenumber as s1, l_partkey as s2, l_suppkey as s3,
 12e0 + (l_partkey % 1000) / 1000e0 as lon, 48e0 + (l_suppkey % 100) / 100e0 as lat
from lineitem
"""

# dependency order of the views
ORDER = ["v_plots", "v_cover", "v_traits", "v_flags", "v_metrics", "v_visits", "v_types", "v_points",
         "v_site", "v_vertices"]
DEPS = {
    "v_flags": ["v_traits"],
    "v_metrics": ["v_cover", "v_flags"],
    "v_visits": ["v_metrics"],
    "v_types": ["v_visits"],
    "v_points": ["v_types"],
    "v_site": ["v_points", "v_plots"],
}


def _closure(names: list[str]) -> list[str]:
    need: set[str] = set()
    stack = list(names)
    while stack:
        v = stack.pop()
        if v not in need:
            need.add(v)
            stack.extend(DEPS.get(v, []))
    return [v for v in ORDER if v in need]


def with_views(views: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views + extra ctes> <body>``."""
    ctes = [f"{v} as ({VIEWS[v].strip()})" for v in _closure(views)]
    ctes += [f"{n} as ({t.strip()})" for n, t in (extra or [])]
    return "with " + ",\n".join(ctes) + "\n" + body.strip()
