"""Incremental refresh: anchors, overlaps, upserts on a key, freshness, versioned tables, artifacts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import expected_week
from ..functions.windows import top_n_per_group
from ..sources.stored import drop_path, list_names, move, read_text, write_text

COLD_START = "2018-01-01"


def anchor(df: DataFrame, column: str, cold_start: str = COLD_START) -> DataFrame:
    """One row: the greatest date stored, the cold start if there is none."""
    return df.agg(F.coalesce(F.max(F.col(column).cast("date")), F.lit(cold_start).cast("date")).alias("anchor"))


def overlap(source: DataFrame, stored: DataFrame, column: str, days: int, inclusive: bool = True) -> DataFrame:
    """Source rows from ``days`` before the anchor of what is stored, so that late corrections are read again."""
    floor = anchor(stored, column).select(F.date_sub("anchor", days).alias("__floor"))
    keep = F.col(column) >= F.col("__floor") if inclusive else F.col(column) > F.col("__floor")
    return source.crossJoin(F.broadcast(floor)).filter(keep).drop("__floor")  # one row


def keep_last(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing and new rows, of each key the last: new ones win, among them the greatest ``load_seq`` if there is one."""
    seq = F.col("load_seq") if "load_seq" in new.columns else F.lit(0)
    both = existing.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return top_n_per_group(both, keys, [F.col("__src").desc(), seq.desc_nulls_last() if "load_seq" in both.columns else F.col("__src")]).drop("__src")


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Upsert on a unique key: all columns overwritten, or only those in ``update`` (the others keep the stored value)."""
    if update is None:
        return target.join(source, list(keys), "left_anti").unionByName(source)
    taken = source.withColumn("__hit", F.lit(True))
    both = target.alias("t").join(taken.alias("s"), list(keys), "full")
    cols: list[Column] = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(F.col("__hit"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}") if c in source.columns else F.lit(None)).alias(c))
    return both.select(*cols)


def fill_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Only null or blank values are taken from the source."""
    s = source.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    out = target.join(s, list(keys), "left")
    for c in columns:
        own = F.nullif(F.trim(F.col(c)), F.lit("")) if dict(target.dtypes)[c] == "string" else F.col(c)
        out = out.withColumn(c, F.coalesce(own, F.col(f"__{c}")))
    return out.drop(*(f"__{c}" for c in columns))


def fresh_daily(latest: Column, as_of: Column, days: int = 2) -> Column:
    return F.coalesce(F.datediff(as_of, latest) <= days, F.lit(False))


def fresh_weekly(latest: Column, as_of: Column, days: int = 6) -> Column:
    """The expected chart week is there, or the latest is not older than ``days``."""
    return F.coalesce((latest >= expected_week(as_of)) | (F.datediff(as_of, latest) <= days), F.lit(False))


def refreshed_if_advanced(stored: DataFrame, source: DataFrame, column: str) -> DataFrame:
    """The source if its greatest date is beyond the stored one, else what is stored: a refresh that may be none. Same columns."""
    both = anchor(stored, column).select(F.col("anchor").alias("__old")).crossJoin(anchor(source, column).select(F.col("anchor").alias("__new")))
    state = F.broadcast(both.select((F.col("__new") > F.col("__old")).alias("__advanced")))  # one row
    return source.join(state, F.col("__advanced")).unionByName(stored.join(state, ~F.col("__advanced"))).drop("__advanced")


def without_partial_week(series: DataFrame, keys: Sequence[str], column: str, as_of: Column, lag_days: int = 3) -> DataFrame:
    """Series without a last week that ended less than ``lag_days`` before ``as_of`` or is not over: it is forecast instead."""
    w = Window.partitionBy(*keys)
    last = F.col(column) == F.max(column).over(w)
    return series.withColumn("__partial", last & (F.col(column) >= F.date_sub(as_of, lag_days))).filter(~F.col("__partial")).drop("__partial")


class Conflict(Exception):
    """Another writer has written this version."""


class VersionedTable:
    """Versions of a table under numbered pointers: a version is written whole to a folder of its own, then its pointer is put in place.

    The highest pointer wins, and pointers are never replaced, so a crash at any time leaves the version before. A pointer is a
    folder that is renamed to its number: the file system must not let a rename replace a folder (HDFS and POSIX do not).
    """

    def __init__(self, spark: SparkSession, root: str, form: str = "parquet", **options: str):
        self.spark, self.root, self.form, self.options = spark, root.rstrip("/"), form, options

    def current(self) -> int:
        return max((int(x) for x in list_names(self.spark, f"{self.root}/pointers") if x.isdigit()), default=0)

    def _pointer(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/pointers/{version:09d}/pointer.json"))

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.current() if version is None else version
        if not version:
            return None
        pointer = self._pointer(version)
        return self.spark.read.format(self.form).options(**self.options).schema(pointer["schema"]).load(f"{self.root}/{pointer['folder']}")

    def write(self, df: DataFrame) -> int:
        """Write the next version; ``df`` may read the current one. Raises Conflict if another writer was first."""
        version, name = self.current() + 1, uuid.uuid4().hex
        df.write.format(self.form).options(**self.options).save(f"{self.root}/v{version}-{name}")
        schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
        aside = f"{self.root}/pointers/.{name}"
        write_text(self.spark, f"{aside}/pointer.json", json.dumps({"folder": f"v{version}-{name}", "schema": schema}))
        try:
            move(self.spark, aside, f"{self.root}/pointers/{version:09d}")
        except FileExistsError:
            raise Conflict(version) from None
        if self._pointer(version)["folder"] != f"v{version}-{name}":
            raise Conflict(version)
        return version

    def reload(self, df: DataFrame) -> int:
        """All rows go and those of ``df`` come, in one step for readers."""
        return self.write(df)

    def upsert(self, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> int:
        current = self.read()
        return self.write(source if current is None else merge_upsert(current, source, keys, update))

    def append_merge(self, new: DataFrame, keys: Sequence[str]) -> int:
        """Existing and new rows, of each key the last."""
        current = self.read()
        return self.write(new if current is None else keep_last(current, new, keys))

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the latest ``keep`` versions, pointers first."""
        pointers = [x for x in list_names(self.spark, f"{self.root}/pointers") if x.isdigit()]
        for x in pointers[:-keep]:
            folder = self._pointer(int(x))["folder"]
            drop_path(self.spark, f"{self.root}/pointers/{x}")
            drop_path(self.spark, f"{self.root}/{folder}")


def save_artifacts(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], settings: Mapping[str, object]) -> None:
    """A model as a folder: its tables as Parquet, then its settings as JSON, whose presence says that it is whole."""
    for name, table in tables.items():
        table.write.parquet(f"{root}/{name}")
    write_text(spark, f"{root}/settings.json", json.dumps({"tables": sorted(tables), "settings": settings}, sort_keys=True))


def load_artifacts(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], dict[str, object]]:
    document = json.loads(read_text(spark, f"{root}/settings.json"))
    return {x: spark.read.parquet(f"{root}/{x}") for x in document["tables"]}, document["settings"]
