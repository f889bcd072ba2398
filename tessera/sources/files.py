"""File sources and sinks: CSV with a column contract, CSV to Parquet, binary art files, rounded JSON records, documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_split import read_split
from .stored import write_text


class MissingColumns(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], aliases: Mapping[str, Sequence[str]] | None = None, multi_line: bool = False, **options: str) -> DataFrame:
    """Columns of a CSV file by name, whatever the case, with white space and a byte order mark in the header ignored.

    ``columns``: type by name; ``aliases``: older names by name. Values that do not fit their type become null. ``multi_line``: values may
    hold line breaks in quotes; files are split either way.
    """
    raw = read_split(spark, path, **options) if multi_line else spark.read.options(header="true", escape='"', **options).csv(path)
    found = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}
    out, missing = [], []
    for name, kind in columns.items():
        source = next((found[x.lower()] for x in (name, *(aliases or {}).get(name, ())) if x.lower() in found), None)
        if source is None:
            missing.append(name)
        else:
            out.append(F.trim(F.col(f"`{source}`")).try_cast(kind).alias(name))
    if missing:
        raise MissingColumns(", ".join(missing))
    return raw.select(*out)


def csv_to_parquet(
    spark: SparkSession, source: str, target: str, compression: str = "snappy", schema: T.StructType | str | None = None, multi_line: bool = False, row_group_bytes: int | None = None, range_bytes: int | None = None
) -> DataFrame:
    """Without a schema all columns are text. ``multi_line``: values may hold line breaks in quotes; files are split either way, then in ranges of ``range_bytes``.
    ``row_group_bytes``: size of a row group before compression."""
    reader = spark.read.options(header="true", escape='"')
    rows = read_split(spark, source, schema, range_bytes) if multi_line else (reader.schema(schema) if schema else reader).csv(source)
    writer = rows.write.mode("overwrite").option("compression", compression)
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(target)
    return spark.read.parquet(target)


def art_flags(spark: SparkSession, path: str, ids: DataFrame, column: str) -> DataFrame:
    """Which ids have a file named after them: names only, contents are not read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(path).select(F.regexp_extract("path", "([^/]+)\\.[^.]+$", 1).alias("__id")).distinct()
    return ids.join(names, F.col(column).cast("string") == F.col("__id"), "left").withColumn("has_artwork", F.col("__id").isNotNull()).drop("__id")


def json_records(df: DataFrame, shares: Sequence[str] = ()) -> DataFrame:
    """One JSON text a row: shares to two decimals, other numbers to whole ones (half to even), dates in ISO form, NaN as null."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.when(~F.isnan(c.cast("double")), c.cast("double"))
            c = F.round(c, 2) if name in shares else F.bround(c, 0).cast("long")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def csv_lines(df: DataFrame, two_decimals: Sequence[str] = ()) -> DataFrame:
    """One CSV line a row, the header apart in ``csv_header``: what a download gives, with some columns to two decimals."""
    cols = [(F.round(F.col(c).cast("double"), 2) if c in two_decimals else F.col(c)).alias(c) for c in df.columns]
    return df.select(F.to_csv(F.struct(*cols)).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def write_document(df: DataFrame, path: str) -> None:
    """A table of one JSON text as one file, written aside and renamed over what is there in one step."""
    spark = df.sparkSession
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    aside = f"{path}.{uuid4().hex}.tmp"
    write_text(spark, aside, df.first()[0])
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(aside), target, options)
