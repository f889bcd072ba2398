"""Streaming twins: weekly windows, deduplication, upserts by micro-batch, custom state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.windows import top_n_per_group
from ..sources.stored import drop_path, list_names, new_path


def event_stream(spark: SparkSession, directory: str, table: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """The rows of a table as a stream; timestamps with the session's zone, so that watermarks can be set."""
    path = f"{directory}/{table}.parquet"
    # a pattern, so that a table may be one file or a folder of files
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def weekly(events: DataFrame, late: str | None = "3 days") -> DataFrame:
    """Counts and sums by chart week (Friday to Thursday) and type; rows later than ``late`` are dropped, none if it is None."""
    week = F.window("ts", "7 days", startTime="1 day")
    grouped = (events.withWatermark("ts", late) if late else events).groupBy(week, "event_type")
    sums = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.select(F.date_sub(F.col("window.end").cast("date"), 1).alias("week_end"), "event_type", "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str | None = "3 days") -> DataFrame:
    """The first row of each key; without ``late`` no row is too late and all keys are kept to the end."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    x = events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count(F.lit(1)).alias("n"))
    return x.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def running_totals(events: DataFrame) -> DataFrame:
    """Events of each user so far, in state of our own."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)


def upsert_each_batch(stream: DataFrame, target: str, keys: list[str], checkpoint: str, sequence: str) -> None:
    """Run a stream to its end, upserting each micro-batch into a versioned table: of a key, the row with the greatest ``sequence`` wins.

    A correction wins whatever its values, and a row that comes late with a lower sequence than the stored one does not.
    """
    from ..operators.incremental import VersionedTable

    def put(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, target)
        stored = table.read()
        rows = batch.withColumn("__batch", F.lit(number))
        if stored is not None:
            rows = rows.unionByName(stored.withColumn("__batch", F.lit(-1)))
        table.write(top_n_per_group(rows, keys, [F.col(sequence).desc_nulls_last(), F.col("__batch").desc()]).drop("__batch"))
        table.vacuum()

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """All rows that a stream gives until its input ends; of an updating stream, the last row of each key."""
    spark = stream.sparkSession
    root = new_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/{number:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    drop_path(spark, f"{root}/state")
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])
    if not list_names(spark, f"{root}/out"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    if keys:
        rows = top_n_per_group(rows, keys, [F.col("__batch").desc()])
    return rows.drop("__batch")
