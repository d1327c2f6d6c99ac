"""Wide species matrices (R4, P4): one row per species, one column per visit, header-driven.

A matrix is a folder of sheets (delimited text, one header line each).  A sheet's visit
columns never become Spark columns: a line is one array of cells, exploded with its
position, and the position looks the visit up in the header array of the line's file.
Ten visit columns and ten thousand are the same plan.  Headers may differ from file to
file; they come from the first line of each file (``_metadata``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.sources.csv import PIPELINE_NA, WRITE_NA, write_line_files


def _quoted(c: Column, sep: str) -> Column:
    """CSV quoting of a text field that needs it."""
    needs = c.contains('"') | c.contains(sep) | c.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_matrix(cover: DataFrame, path: str, *, row: str = "name", column: str = "id", value: str = "n",
                 sheet: str = "sheet", sep: str = ",", na: str = WRITE_NA) -> str:
    """Write a long table as a folder of matrix sheets, one file per value of ``sheet`` (int).

    (sheet, row, column) is unique.  A sheet holds the rows that occur in one of its columns; missing cells
    are written as ``na``.  Choose sheets so that one sheet's columns fit in an array.
    """
    text = F.col(value).cast("string")
    heads = cover.groupBy(sheet).agg(F.array_sort(F.collect_set(column)).alias("_ids"))
    rows = (cover.groupBy(sheet, F.col(row).cast("string").alias("_row"))
            .agg(F.map_from_entries(F.collect_list(F.struct(F.col(column), text))).alias("_cells"))
            .join(heads, sheet))
    cells = F.transform("_ids", lambda i: F.coalesce(F.element_at("_cells", i), F.lit(na)))
    body = rows.select(F.col(sheet).alias("file"), F.concat_ws(sep, _quoted(F.col("_row"), sep), F.array_join(cells, sep)).alias("value"))
    head = heads.select(F.col(sheet).alias("file"), F.lit(0).alias("at"), F.concat_ws(sep, F.lit(row), F.array_join("_ids", sep)).alias("value"))
    return write_line_files(head, body, path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def _fields(line: Column, sep: str) -> Column:
    """The fields of a line behind its first one; they hold no separators."""
    first = r'^(?:"(?:[^"]|"")*"|[^' + _cls(sep) + r']*)' + _lit(sep)
    return F.transform(F.split(F.regexp_replace(line, first, ""), _lit(sep), -1), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))


def _lit(sep: str) -> str:
    return r"\Q" + sep + r"\E"


def _cls(sep: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in sep.replace("\t", "")) + ("\t" if "\t" in sep else "")


def matrix_headers(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, header, ids): first line of every file and the names of its cell columns.

    A file's first block is read in order by one task, so the line with the smallest running id is its first.
    """
    first = (_lines(spark, path).where("start = 0").withColumn("_at", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("value", "_at").alias("header")))
    return first.select("file", "header", _fields(F.col("header"), sep).alias("ids"))


def read_matrix(spark: SparkSession, path: str, *, visits: DataFrame | None = None, row: str = "name", column: str = "id",
                value: str = "n", sep: str = ",", dec: str = ".", tokens: Sequence[str] = PIPELINE_NA) -> DataFrame:
    """The matrix as a long table (row, column, value) without missing cells.

    ``visits``: a table with ``column``; only its visits are kept (P4), and a visit that no header names
    is an error.  Cells that are NA tokens or no numbers are missing.  A line equal to its file's header is a header.
    """
    heads = matrix_headers(spark, path, sep)
    if visits is not None:
        named = heads.select(F.explode("ids").alias(column)).distinct()
        visits = visits.select(column).distinct()
        missing = [r[0] for r in visits.join(named, column, "left_anti").limit(10).collect()]
        if missing:
            raise ValueError(f"visits without a column in {path}: {missing}")
    raw = F.col("_name")
    bare = F.replace(F.expr("substring(_name, 2, length(_name) - 2)"), F.lit('""'), F.lit('"'))
    name = F.when(raw.startswith('"'), bare).otherwise(raw)
    # no size hint: headers grow with the files, Spark's size check picks the join
    body = (_lines(spark, path).join(heads, "file").where(F.col("value") != F.col("header"))
            .withColumn("_name", F.regexp_extract("value", r'^("(?:[^"]|"")*"|[^' + _cls(sep) + r"]*)", 1)))
    cells = body.select(name.alias(row), "ids", F.posexplode(_fields(F.col("value"), sep)).alias("_pos", "_cell"))
    cells = cells.where(~F.col("_cell").isin(*tokens) if tokens else F.lit(True))
    number = (F.replace("_cell", F.lit(dec), F.lit(".")) if dec != "." else F.col("_cell")).try_cast("double")
    out = cells.select(row, F.get("ids", F.col("_pos")).alias(column), number.alias(value)).where(F.col(value).isNotNull() & F.col(column).isNotNull())
    return out.join(visits, column, "left_semi").select(row, column, value) if visits is not None else out
