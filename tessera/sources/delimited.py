"""CSV and TSV in and out, through Spark's own reader and writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parsed_date
from ..functions.values import NUMERIC
from ..operators.view import View, shown
from ..plans.rows import ROW


def parse_input(c: Column, kind: str) -> Column:
    """Text typed into a cell of a number, currency, date, boolean or text column; what doesn't parse is null (text stays)."""
    t = F.trim(c)
    if kind in ("number", "currency"):
        bare = F.regexp_replace(t, r"[$€£¥,\s]", "")
        sign = F.when(t.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)
        bare = F.regexp_replace(bare, r"^\((.*)\)$", "$1")
        percent = bare.endswith("%")
        bare = F.regexp_replace(bare, "%$", "")
        return F.when(bare.rlike(NUMERIC), F.when(bare.rlike(NUMERIC), bare).try_cast("double") * sign / F.when(percent, 100.0).otherwise(1.0))
    if kind == "date":
        return F.coalesce(parsed_date(t), F.when(t.rlike(NUMERIC), F.when(t.rlike(NUMERIC), t).try_cast("double")))
    if kind == "boolean":
        return F.when(F.upper(t) == "TRUE", True).when(F.upper(t) == "FALSE", False)
    return F.when(c != "", c)


def read_delimited(spark: SparkSession, path: str, columns: Sequence[tuple[str, str, bool]], header: bool = True, sep: str = ",") -> DataFrame:
    """Columns (key, kind, visible) meet the file's fields by position: fields fill the visible ones, extra fields are
    dropped, missing ones and hidden columns are null. Quoted fields may hold separators and line ends."""
    fields = [k for k, _, v in columns if v]
    schema = T.StructType([T.StructField(k, T.StringType()) for k in fields])
    raw = spark.read.schema(schema).csv(path, header=header, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # a byte order mark may lead the first field of a file without a header
    if not header and fields:
        raw = raw.withColumn(fields[0], F.regexp_replace(fields[0], "^﻿", ""))
    typed = {"number": "double", "currency": "double", "date": "double", "boolean": "boolean", "text": "string"}
    return raw.select(*[parse_input(F.col(f"`{k}`"), kind).alias(k) if v else F.lit(None).cast(typed[kind]).alias(k) for k, kind, v in columns])


def hardened(c: Column) -> Column:
    """A leading =, +, -, @, tab or carriage return gets an apostrophe, so that no program runs the cell."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def encoded(df: DataFrame, columns: Sequence[str], sep: str = ",", harden: bool = True) -> DataFrame:
    """One line of text per row, fields quoted where they need it."""
    def field(name: str) -> Column:
        s = F.coalesce(shown(df, name), F.lit(""))
        s = hardened(s) if harden and dict(df.dtypes)[name] == "string" else s
        return F.when(s.rlike(f'["\r\n{sep}]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return df.select(ROW, F.concat_ws(sep, *[field(c) for c in columns]).alias("line"))


def write_csv(df: DataFrame, path: str, view: View | None = None, columns: Sequence[str] | None = None, harden: bool = True) -> None:
    """The view's rows in view order, visible columns, headers, CRLF: part files in order."""
    cols = list(columns or [c for c in df.columns if c != ROW and not c.endswith("_err")])
    plan = (view or View()).plan(df)
    lines = encoded(plan, cols, harden=harden)
    head = ",".join(f'"{c}"' if any(x in c for x in ',"\r\n') else c for c in cols)
    order = (view or View()).order()
    sorted_lines = encoded(plan.repartitionByRange(*order).sortWithinPartitions(*order), cols, harden=harden).select("line") if order else lines.select("line")
    del lines
    spark = df.sparkSession
    spark.range(1).select(F.concat(F.lit("﻿"), F.lit(head)).alias("line")).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/head")
    sorted_lines.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/body")


def write_tsv(df: DataFrame, path: str, first: int, last: int, columns: Sequence[str]) -> None:
    """Rows first..last of some columns, in data order."""
    part = df.where(F.col(ROW).between(first, last))
    encoded(part.repartitionByRange(ROW).sortWithinPartitions(ROW), columns, sep="\t", harden=False).select("line").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path)
