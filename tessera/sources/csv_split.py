"""CSV files whose values hold line breaks, read by many tasks a file.

A line break ends a record only outside quotes, and whether a byte range begins inside quotes depends on all before it. Each range tells by how much it changes that: the parity of
its quotes. Parities compose, so a running sum over the ranges of a file, one row each, gives every range its state; a second pass then cuts each range into records. What a
range leaves open is joined with the beginning of the next ones, so that a record may be as long as it likes.

The ranges are Spark's own (``spark.sql.files.maxPartitionBytes``, or ``range_bytes`` while the files are read). Quotes are doubled inside quoted values, and stand nowhere else (RFC 4180). Line ends are ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import written

RANGE_SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
#: What a range has of a record: all of it; its end, its middle, or its beginning.
WHOLE, END, MIDDLE, BEGINNING = 0, 1, 2, 3


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of each byte range (file, first byte) of a task, in order."""
    rows = ((key, line) for batch in batches for *key, line in zip(*(c.to_pylist() for c in batch.columns)))
    row = next(rows, None)
    while row is not None:
        now = row[0]

        def lines() -> Iterator[str]:
            nonlocal row
            while row is not None and row[0] == now:  # noqa: B023
                yield row[1]
                row = next(rows, None)

        yield (now[0], now[1]), lines()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, at), lines in _ranges(batches):
        odd = sum(line.count('"') for line in lines) & 1
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at], pa.int64()), pa.array([odd], pa.int32())], names=["file", "at", "odd"])


def _pieces(inside: set[tuple[str, int]]):
    """Records and parts of records; ``inside``: the ranges that begin in quotes."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, int, str]] = []

        def given() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * 5
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "at", "kind", "number", "text"])

        for (file, at), lines in _ranges(batches):
            quoted = begun = (file, at) in inside
            held, number = [], 0
            for line in lines:
                held.append(line)
                quoted ^= bool(line.count('"') & 1)
                if not quoted:
                    out.append((file, at, END if begun else WHOLE, number, "\n".join(held)))
                    held, begun, number = [], False, number + 1
                    if len(out) >= 5000:
                        yield given()
                        out = []
            if held:
                out.append((file, at, MIDDLE if begun else BEGINNING, number, "\n".join(held)))
        yield given()

    return pieces


@contextmanager
def _ranges_of(spark: SparkSession, n_bytes: int | None) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in RANGE_SETTINGS}
    try:
        for k in RANGE_SETTINGS if n_bytes else ():
            spark.conf.set(k, str(n_bytes))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def records(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """The records of CSV files as text: file, at and number (which order a file's records), text."""
    with _ranges_of(spark, range_bytes):  # both passes run inside
        found = _found(spark, path)
    return _records(found)


def _found(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    parities = lines.mapInArrow(_parities, "file string, at long, odd int")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begins = parities.withColumn("quotes", F.coalesce(F.sum("odd").over(before), F.lit(0)))
    inside = {(r["file"], r["at"]) for r in begins.filter("quotes % 2 = 1").collect()}  # of each range one number at most
    return written(lines.mapInArrow(_pieces(inside), "file string, at long, kind int, number long, text string"), "csv-pieces")


def _records(found: DataFrame) -> DataFrame:
    # a record in parts: its beginning, whole ranges, its end
    parts = found.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("at", "number")
    chain = F.sum((F.col("kind") == BEGINNING).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.withColumn("chain", chain).groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("at", "number", "text"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    joined = joined.select("file", F.get("parts", F.lit(0))["at"].alias("at"), F.get("parts", F.lit(0))["number"].alias("number"), whole.alias("text"))
    every = found.filter(F.col("kind") == WHOLE).select("file", "at", "number", "text").unionByName(joined)
    return every.withColumn("text", F.regexp_replace("text", "\r$", "")).filter(F.trim("text") != "")


def read_split(spark: SparkSession, path: str, schema: T.StructType | str | None = None, range_bytes: int | None = None, **options: str) -> DataFrame:
    """The table of CSV files with a header, the same in all of them; columns are text without a schema."""
    every = written(records(spark, path, range_bytes), "csv-records")
    first = every.groupBy("file").agg(F.min(F.struct("at", "number")).alias("first")).select("file", "first.*")
    head = every.join(first, ["file", "at", "number"]).select("text").first()
    if head is None:
        return spark.createDataFrame([], schema if schema is not None else T.StructType())
    if schema is None:
        names = next(csv.reader([head["text"]], delimiter=options.get("sep", ",")))
        schema = T.StructType([T.StructField(n or f"_c{k}", T.StringType()) for k, n in enumerate(names)])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    body = every.join(first, ["file", "at", "number"], "left_anti")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    row = F.from_csv("text", ddl, {"escape": '"', "multiLine": "true", **options}).alias("row")
    return body.select(row).select("row.*")
