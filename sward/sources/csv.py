"""Typed delimited-text ingest with several NA tokens (S1-S4) and CSV sinks.

Files of one folder may have different headers; they are grouped by header and each group
is read under its own schema.  Spark's CSV reader accepts a single ``nullValue``; the reference treats
several tokens as NA and casts per column, with bad number text becoming NA.
So every column is read as text under an explicit schema (no inference
pass), then one projection maps the tokens to NULL and ``try_cast`` /
``try_to_date`` type the columns (plain casts raise under ANSI mode).
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.functions.rsem import null_tokens

# ---- fixed values of the reference ----
PIPELINE_NA = ("", "NA", "na")
APP_NA = ("na", "NA")
WRITE_NA = "NA"
# ----------------------------------------
#: Column of lines that have too few or too many fields.
_BAD = "_bad_line"


def _head_lines(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """(file, at, rn, value) of the first ``skip`` + 1 lines of every file, ``at`` as in :func:`_numbered`.

    One task reads a file's first block in order; the rank keeps a bounded number of lines of each file per task.
    """
    first = Window.partitionBy("file").orderBy("at")
    return _numbered(spark, path).where("start = 0").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= skip + 1)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, at): text lines with a running number that is the same in every scan of the folder."""
    return (spark.read.option("recursiveFileLookup", True).text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
            .withColumn("at", F.monotonically_increasing_id()))


def _names(header: str, sep: str) -> list[str]:
    return [n.strip() for n in next(csv.reader([header.lstrip("\ufeff")], delimiter=sep))]


def _text_columns(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in [*names, _BAD]])


def _by_header(spark: SparkSession, path: str, columns: Mapping[str, str], sep: str, skip: int) -> list[DataFrame]:
    """One text DataFrame for every distinct header of the folder's files."""
    heads = _head_lines(spark, path, skip)
    groups: dict[str, list[str]] = {}
    for r in heads.where(F.col("rn") == skip + 1).select("file", "value").collect():  # one row a file, as in Spark's listing
        groups.setdefault(r["value"], []).append(r["file"])
    if not groups:
        raise ValueError(f"no header line in {path}")
    out = []
    for header, files in groups.items():
        names = _names(header, sep)
        missing = [c for c in columns if c not in names]
        if missing:
            raise ValueError(f"columns not in {files[0]}: {missing}")
        schema = _text_columns(names)
        if not skip:
            out.append(spark.read.schema(schema).option("header", True).option("sep", sep)
                       .option("columnNameOfCorruptRecord", _BAD).csv(files))
            continue
        body = (_numbered(spark, path).join(heads.select("file", "at"), ["file", "at"], "left_anti")
                .join(heads.where((F.col("rn") == skip + 1) & (F.col("value") == header)).select("file"), "file", "left_semi"))
        fields = F.from_csv("value", _ddl(schema), {"sep": sep, "columnNameOfCorruptRecord": _BAD})
        out.append(body.where(F.trim("value") != "").select(fields.alias("_r")).select("_r.*"))
    return out


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` string" for f in schema)


def read_typed_csv(spark: SparkSession, path: str, columns: Mapping[str, str],
                   tokens: Sequence[str] = PIPELINE_NA, sep: str = ",", dec: str = ".",
                   header: bool = True, skip: int = 0, uniform: bool = False) -> DataFrame:
    """Read a delimited file, or a folder of files, with per-column types.

    Columns are bound by header name, as R's readers do, file by file: files of one folder may order
    their columns differently or have more of them.  ``columns`` maps names to ``string``, ``int``,
    ``bigint``, ``double`` or ``date:<pattern>`` (e.g. ``date:yyyy-MM-dd``).  Columns that are not listed stay
    text (NULL for files without them).  ``skip`` lines come before each file's header.

    Headers cost a pass over the first block of each file.  ``uniform``: all files have the
    same header; that pass is left out and a file with another header is an error.

    NULL and empty text are kept apart: an empty field, quoted or not, is NULL only if "" is among ``tokens``; a field
    that its line does not have is always NULL.  Without inference every field is read as text.
    """
    if not header:
        if skip:
            raise ValueError("skip needs a header")
        parts = [spark.read.schema(_text_columns(list(columns))).option("header", False).option("sep", sep)
                 .option("columnNameOfCorruptRecord", _BAD).csv(path)]
    elif uniform and not skip:
        names = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns
        missing = [c for c in columns if c not in names]
        if missing:
            raise ValueError(f"columns not in {path}: {missing}")
        parts = [spark.read.schema(_text_columns(names)).option("header", True).option("sep", sep).option("enforceSchema", False)
                 .option("columnNameOfCorruptRecord", _BAD).csv(path)]
    else:
        parts = _by_header(spark, path, columns, sep, skip)
    raw = None
    for p in parts:
        names = [c for c in p.columns if c != _BAD]
        if "" not in tokens:
            # the reader gives NULL for an empty field; it marks lines that lack fields
            p = p.select(*[F.when(F.col(f"`{c}`").isNull() & F.col(_BAD).isNull(), "").otherwise(F.col(f"`{c}`")).alias(c) for c in names])
        else:
            p = p.select(*[F.col(f"`{c}`") for c in names])
        raw = p if raw is None else raw.unionByName(p, allowMissingColumns=True)
    raw = null_tokens(raw, tokens)
    out = []
    for name in raw.columns:
        typ = columns.get(name, "string")
        c = F.col(f"`{name}`")
        if typ.startswith("date:"):
            out.append(F.try_to_date(c, typ.split(":", 1)[1]).alias(name))
        elif typ in ("double", "float"):
            txt = F.replace(c, F.lit(dec), F.lit(".")) if dec != "." else c
            out.append(txt.try_cast("double").alias(name))
        elif typ in ("int", "bigint"):
            out.append(c.try_cast(typ).alias(name))
        elif typ == "string":
            out.append(c.alias(name))
        else:
            raise ValueError(f"unsupported column type {typ!r} for {name!r}")
    return raw.select(*out)


def write_line_files(heads: DataFrame, body: DataFrame, path: str) -> str:
    """Text files that start with their own head lines: heads (file int, at int, value), body (file int, value).

    One file per value of ``file``, written by one task.
    """
    lines = heads.select("file", "at", "value").unionByName(body.select("file", F.lit(2**31 - 1).alias("at"), "value"))
    (lines.repartition("file").sortWithinPartitions("file", "at").select("file", "value")
     .write.mode("overwrite").partitionBy("file").text(path))
    return path


def write_csv(df: DataFrame, path: str, na: str = WRITE_NA) -> str:
    """Header CSV, NULL written literally as ``NA`` (as ``write_csv`` does)."""
    df.write.mode("overwrite").option("header", True).option("nullValue", na).option("emptyValue", "").csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Primary sink: Parquet, optionally partitioned (e.g. by surveyYear for pruning)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
