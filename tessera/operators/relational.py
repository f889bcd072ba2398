"""Reusable relational operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def facets(df: DataFrame, equal: Mapping[str, str | None] | None = None, least: Mapping[str, object] | None = None, most: Mapping[str, object] | None = None) -> DataFrame:
    """Optional predicates: text columns equal but for case, lower and upper bounds; None means no predicate."""
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.filter(F.lower(F.trim(F.col(name))) == value.strip().lower())
    for name, value in (least or {}).items():
        if value is not None:
            df = df.filter(F.col(name) >= F.lit(value))
    for name, value in (most or {}).items():
        if value is not None:
            df = df.filter(F.col(name) <= F.lit(value))
    return df


def with_ids(df: DataFrame, column: str, ids: Iterable[object]) -> DataFrame:
    """Rows whose column is in a list of the caller, as a semi-join, so that the plan does not grow with the list."""
    table = df.sparkSession.createDataFrame([(x,) for x in ids], f"{column} {dict(df.dtypes)[column]}")
    return df.join(table, column, "left_semi")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    """A page of at most ``limit`` rows and whether there are more: columns has_more and next_offset on every row."""
    limit = max(1, min(limit, most))
    ahead = df.orderBy(*order).offset(offset).limit(limit + 1)
    from pyspark.sql import Window

    w = Window.orderBy(*order)  # over limit + 1 rows at most
    numbered = ahead.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    return numbered.filter(F.col("__rn") <= limit).withColumn("has_more", F.col("__n") > limit).withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit).cast("long"))).drop("__rn", "__n")


def conditional_sums(value: Column, by: Column, names: Mapping[str, str]) -> list[Column]:
    """One sum for each value of ``by``: a pivot whose columns are known beforehand."""
    return [F.sum(F.when(by == v, value).otherwise(F.lit(0).cast("decimal(18,4)"))).alias(n) for v, n in names.items()]


def any_flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).cast("long")


def union_padded(*parts: DataFrame) -> DataFrame:
    """All rows of tables with different columns; missing ones are null."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def crosstab_association(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square and Cramer's V of two columns from the counts of the cells that occur: n (sum of o^2 / (row * column) - 1)."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("row_n")), cells.groupBy(b).agg(F.sum("n").alias("col_n"))
    full = cells.join(rows, a).join(cols, b)
    total = F.sum("n")
    chi = total * (F.sum(F.col("n") * F.col("n") / (F.col("row_n") * F.col("col_n"))) - 1)
    least = F.least(F.countDistinct(a), F.countDistinct(b)) - 1
    return full.agg(chi.alias("chi_square"), F.sqrt(chi / total / least).alias("cramers_v"), total.alias("n"))


def weighted_sample(df: DataFrame, weight: Column, n: int, key: str, seed: int = 7) -> DataFrame:
    """n rows without replacement, with chances in proportion to the weights: the n least exponential keys."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return df.withColumn("__key", -F.log(u) / weight).filter(weight > 0).orderBy("__key", key).limit(n).drop("__key")


def week_grid(spark: SparkSession, entities: DataFrame, start: str, weeks: int, name: str = "week_end") -> DataFrame:
    """Each entity with each of ``weeks`` weeks after the date column ``start``."""
    steps = F.sequence(F.date_add(F.col(start), 7), F.date_add(F.col(start), 7 * weeks), F.expr("interval 7 days"))
    return entities.withColumn(name, F.explode(steps))
