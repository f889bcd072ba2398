"""What the operators share: stored tables, joins by identifier, hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import drop_path, list_names, move, new_path, shared_dir, temporary, written, written_at

__all__ = ["drop_path", "filtered", "fresh", "input_table", "joined_by_weight", "list_names", "move", "new_path", "shared_dir", "temporary", "text_or_empty", "written", "written_at"]


def joined_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key; ``weight``: at least how many of the rows have the key.

    Keys with more than a 4P-th of all weight (P: shuffle partitions) are at most 4P: these rows are joined where they are, by
    a broadcast of that size. The others are joined by a shuffle at every size, in which no key fills a task. No key is null.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = (table.agg(F.sum(weight)).first()[0] or 0) / (4 * parts)
    hot = F.broadcast(table.filter(F.col(weight) > least))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table.filter(F.col(weight) <= least).hint("merge"), key))


def slices(batch, rows: int = 500):
    """Parts of an Arrow batch or array, so that not all of its texts are Python objects at once."""
    return (batch.slice(at, rows) for at in range(0, len(batch), rows)) if len(batch) else iter([batch])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filtered(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of ``docs`` with a table (id), whatever columns ``docs`` has; null equals null."""
    name = fresh(docs, "__id")
    return docs.join(ids.select(F.col("id").alias(name)), F.col(id_col).cast("long").eqNullSafe(F.col(name)), how)


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
