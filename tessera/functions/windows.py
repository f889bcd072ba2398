"""Window helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; a filter on row_number, which Spark turns into a limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def latest_by(df: DataFrame, keys: Sequence[str], by: str, *ties: Column) -> DataFrame:
    return top_n_per_group(df, keys, [F.col(by).desc_nulls_last(), *ties])


def rolling_mean(x: Column, w: WindowSpec, n: int) -> Column:
    """Mean of the n rows before; null with fewer."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def rolling_median(x: Column, w: WindowSpec, n: int, least: int) -> Column:
    """Median of the n rows before; null with fewer than ``least``. The frame bounds the array to n numbers."""
    values = F.sort_array(F.collect_list(x).over(w.rowsBetween(-n, -1)))
    k = F.size(values)
    middle = (F.get(values, F.floor((k - 1) / 2).cast("int")) + F.get(values, F.floor(k / 2).cast("int"))) / 2
    return F.when(k >= least, middle)


def rolling_cv(x: Column, w: WindowSpec, n: int, floor: float = 1e-9) -> Column:
    """Population deviation over the mean of the n rows before; null with fewer."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) == n, F.stddev_pop(x).over(frame) / F.greatest(F.avg(x).over(frame), F.lit(floor)))


def running_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def rows_since(df: DataFrame, flag: Column, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows since the last flagged one (0 at it); before any, rows from the first, which counts 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = df.withColumn("__island", running_sum(F.when(flag, 1).otherwise(0), w))
    n = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(*order))
    return island.withColumn(name, (n - F.when(F.col("__island") > 0, 1).otherwise(0)).cast("long")).drop("__island")


def filled(x: Column, w: WindowSpec) -> Column:
    """The last known value, before the first one the next."""
    back = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(back, F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
