"""Wide <-> long reshapes (R1-R6) and pattern-based projections.

The reference turns the wide plot sheet (one column per measure and year)
into a long table and pivots it back to one row per (plot, year).  The
long/pivot path needs a shuffle; ``wide_to_visits`` gives the same rows with
``explode`` over an array of per-year structs, which is a narrow projection.
Both are provided; the catalogue uses the narrow one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns_matching(df: DataFrame, prefixes: Iterable[str] = (), suffixes: Iterable[str] = (),
                     numeric: bool = False) -> list[str]:
    """``starts_with`` / ``ends_with`` / ``where(is.numeric)`` over the schema."""
    prefixes, suffixes = tuple(prefixes), tuple(suffixes)
    out = []
    for f in df.schema.fields:
        ok = (not prefixes or f.name.startswith(prefixes)) and (not suffixes or f.name.endswith(suffixes))
        if numeric:
            ok = ok and f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")
        if ok:
            out.append(f.name)
    return out


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """P4 ``all_of(names)``: select the listed columns, error when one is missing."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing[:10]}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def relocate(df: DataFrame, cols: Sequence[str], after: str) -> DataFrame:
    """P5 ``relocate(cols, .after = col)``."""
    rest = [c for c in df.columns if c not in cols]
    i = rest.index(after) + 1
    return df.select(*[F.col(f"`{c}`") for c in rest[:i] + list(cols) + rest[i:]])


def unpivot_measures(wide: DataFrame, ids: Sequence[str], measures: Sequence[str],
                     sep: str = "_") -> DataFrame:
    """All ``<measure><sep><year>`` columns -> (ids..., x, surveyYear, n) with n as text."""
    cols = [c for c in wide.columns if any(c.startswith(m + sep) for m in measures)]
    as_text = wide.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    long = as_text.unpivot(list(ids), cols, "_name", "n")
    parts = F.split(F.col("_name"), sep)
    return long.select(*ids, F.get(parts, 0).alias("x"), F.get(parts, 1).alias("surveyYear"), "n")


def pivot_measures(long: DataFrame, ids: Sequence[str], measures: Sequence[str],
                   numeric: Iterable[str] = ()) -> DataFrame:
    """R2 + R3: one row per (ids, year), one column per measure; numbers re-cast with try_cast."""
    numeric = set(numeric)
    wide = (long.groupBy(*ids, "surveyYear").pivot("x", list(measures)).agg(F.first("n")))
    return wide.select(*ids, F.col("surveyYear").try_cast("int").alias("surveyYear"),
                       *[(F.col(m).try_cast("double") if m in numeric else F.col(m)).alias(m)
                         for m in measures])


def measure_years(wide: DataFrame, measures: Sequence[str], sep: str = "_") -> list[int]:
    """The survey years that the measure columns name, in order."""
    found = (c.rsplit(sep, 1) for c in wide.columns if sep in c)
    return sorted({int(y) for m, y in found if m in measures and y.isdigit()})


def wide_to_visits(wide: DataFrame, ids: Sequence[str], measures: Sequence[str], years: Sequence[int] | None = None,
                   numeric: Iterable[str] = (), sep: str = "_") -> DataFrame:
    """R1 + R2 + R3 without a shuffle: explode one struct per year (generated as SQL).

    Years default to those of the columns.  A measure without any column is an error; one that lacks a year is
    NULL in that year, as the pivot leaves it.
    """
    numeric = set(numeric)
    years = list(years) if years is not None else measure_years(wide, measures, sep)
    absent = [m for m in measures if not any(f"{m}{sep}{y}" in wide.columns for y in years)]
    if absent or not years:
        raise ValueError(f"no columns for measures {absent or list(measures)} in years {years}")

    def cell(m: str, y: int) -> str:
        name = f"{m}{sep}{y}"
        c = f"CAST(`{name}` AS STRING)" if name in wide.columns else "CAST(NULL AS STRING)"
        return f"try_cast({c} AS DOUBLE)" if m in numeric else c

    per_year = "explode(array(" + ", ".join(
        "named_struct(" + ", ".join([f"'surveyYear', {int(y)}"] + [f"'{m}', {cell(m, y)}" for m in measures]) + ")"
        for y in years) + ")) AS _v"
    return (wide.selectExpr(*[f"`{i}`" for i in ids], per_year)
            .select(*ids, "_v.surveyYear", *[f"_v.{m}" for m in measures]))


def spread_sum(long: DataFrame, key: Sequence[str], type_col: str, types: Sequence[str],
               value: str, scale: float = 1.0) -> DataFrame:
    """R6 ``spread(type, total)``: sum per (key, type), one column per type; a missing type is NULL."""
    return (long.groupBy(*key).pivot(type_col, list(types))
            .agg((F.sum(value).cast("double") / F.lit(float(scale)))))
