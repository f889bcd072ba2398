"""Stateful streaming deduplication.

Arrivals land in a log with their contents and are streamed through a keyed state without expiry, held on disk by RocksDB. For
each digest it retains the smallest identifier, the locator of the content that came first (part of the log and identifier) and
the number of rows. The state lives as long as its folder: every ``feed`` goes on from the last one. Full contents are compared on hits:
those of the feed's rows whose digest was seen more than once, and what the locator names in earlier parts of the log, which are all that is read of
it. A digest that was found to stand for different contents is remembered as such; from then on its rows are grouped by content over the whole log.

A feed has an identifier. One that died is taken up again where it was by feeding it under the same identifier (its rows are not counted
twice, and what entered the log is used, whatever is given then); a feed under another identifier first brings the state up to the log, so that nothing is lost either way.

Null texts count as empty, so they equal empty texts. Texts are equal when identical after each run of ASCII white
space became one space. A row given twice (same identifier and text) is one group of two rows with one identifier; both
rows get the same verdict, and ``distinct_documents`` returns such a document once. Rows without identifier take part;
a group of only such rows has a null ``keep_id``. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import read_text, write_text
from .shared import filtered, fresh, joined_by_weight, list_names, move, new_path, temporary, text_or_empty, written, written_at

STATE_STORE = "spark.sql.streaming.stateStore"
#: State on disk; each commit writes its changes only, and files and buffers take little room where a partition has little.
SETTINGS = {
    f"{STATE_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE_STORE}.rocksdb.allowFAllocate": "false",
    f"{STATE_STORE}.rocksdb.writeBufferSizeMB": "16",
    f"{STATE_STORE}.rocksdb.boundedMemoryUsage": "true",  # of all of an executor's partitions together
    f"{STATE_STORE}.rocksdb.maxMemoryUsageMB": "192",
}
LOG = "id bigint, content string, digest string"
#: ``origin``: the content that came first, found by the part of the log it is in and its identifier.
UPDATES = "digest string, keep_id bigint, origin struct<part: string, id: bigint>, group_size bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


class DedupState:
    """The state in a folder that the driver and all executors share, opened or made; one feed at a time."""

    def __init__(self, spark: SparkSession, root: str, digest: Callable[[Column], Column] = sha256, batches: int = 4):
        self.spark, self.root, self.digest, self.batches = spark, root.rstrip("/"), digest, batches
        self.log, self.updates, self.checkpoint, self.feeds, self.clashes = (f"{self.root}/{x}" for x in ("log", "updates", "checkpoint", "feeds", "clashes"))

    def _batches(self) -> list[int]:
        return [int(x[6:]) for x in list_names(self.spark, self.updates) if x.startswith("batch=")]

    def _next_batch(self) -> int:
        return max(self._batches(), default=-1) + 1

    def feed(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", feed_id: str | None = None) -> DataFrame:
        """Take in rows; one row for each of them: id, keep_id and group_size among all rows up to this feed, kept, digest.

        feed_id: letters, digits, ``-`` and ``_``; a feed without one cannot be taken up again.
        """
        feed_id = feed_id or uuid.uuid4().hex
        if not re.fullmatch("[A-Za-z0-9_-]+", feed_id):
            raise ValueError(f"not an identifier of a feed: {feed_id!r}")
        parts = [x for x in list_names(self.spark, self.log) if x.startswith("part=")]
        part = next((x for x in parts if x.split("-", 1)[1] == feed_id), None)
        if part is None:
            self._finish(parts)
            part = f"part={len(parts):09d}-{feed_id}"
            content = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_or_empty(text_col)).alias("content"))
            aside = f"{self.root}/aside-{part}"
            content.withColumn("digest", self.digest(F.col("content"))).write.mode("overwrite").parquet(aside)
            move(self.spark, aside, f"{self.log}/{part}")  # all or nothing enters the log
            parts.append(part)
        self._finish(parts[: parts.index(part) + 1])
        span = json.loads(read_text(self.spark, f"{self.feeds}/{part}"))
        return self._verdicts(part, span["since"], span["until"])

    def _finish(self, parts: list[str]) -> None:
        """Bring the state up to the log: only its last part can be unfinished. A part's record says which batches have changed the state for it."""
        if parts and parts[-1] not in list_names(self.spark, self.feeds):
            since = 0
            if len(parts) > 1:
                since = json.loads(read_text(self.spark, f"{self.feeds}/{parts[-2]}"))["until"]
            self._stream(parts[-1])
            self._record(parts[-1], {"since": since, "until": self._next_batch()})

    def _record(self, part: str, span: dict) -> None:
        aside = f"{self.root}/record-{uuid.uuid4().hex}"
        write_text(self.spark, aside, json.dumps(span))
        move(self.spark, aside, f"{self.feeds}/{part}")

    def _stream(self, part: str) -> None:
        """Run what is new in the log through the state; a digest with very many copies costs it one row a task and batch."""
        spark = self.spark
        before = {k: spark.conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        newest = spark.read.schema(LOG).parquet(f"{self.log}/{part}")
        files = max(1, len(newest.inputFiles()))
        try:
            arrived = spark.readStream.schema(LOG).option("maxFilesPerTrigger", -(-files // self.batches)).parquet(f"{self.log}/part=*")
            place = F.struct(F.regexp_extract(F.input_file_name(), "(part=[^/]+)/[^/]*$", 1).alias("part"), "id")
            state = (
                arrived.select("digest", "id", place.alias("place"))
                .groupBy("digest")
                .agg(F.min("id").alias("keep_id"), F.min("place").alias("origin"), F.count(F.lit(1)).alias("group_size"))
            )

            def keep(changed: DataFrame, batch: int) -> None:
                changed.write.mode("overwrite").parquet(f"{self.updates}/batch={batch}")

            query = state.writeStream.outputMode("update").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def digests(self, since: int = 0, until: int | None = None) -> DataFrame:
        """The state of the digests that batches from ``since`` on (and before ``until``) have changed: digest, keep_id, origin, group_size.

        A digest appears once for each micro-batch that changed it; its count only grows, and the rest only falls.
        """
        paths = [f"{self.updates}/batch={b}" for b in self._batches() if since <= b and (until is None or b < until)]
        rows = self.spark.read.schema(UPDATES).parquet(*paths) if paths else self.spark.createDataFrame([], UPDATES)
        return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min("origin").alias("origin"), F.max("group_size").alias("group_size"))

    def _parts(self, names: list[str]) -> DataFrame:
        """Rows of some parts of the log, with ``part``."""
        rows = self.spark.read.schema(f"{LOG}, part string").option("basePath", self.log).parquet(*(f"{self.log}/{x}" for x in names))
        return rows.withColumn("part", F.concat(F.lit("part="), "part"))

    def _known_clashes(self, part: str) -> DataFrame | None:
        names = [x for x in list_names(self.spark, self.clashes) if x < part]
        return self.spark.read.schema("digest string").parquet(*(f"{self.clashes}/{x}" for x in names)) if names else None

    def _verdicts(self, part: str, since: int, until: int) -> DataFrame:
        spark = self.spark
        fed = spark.read.schema(LOG).parquet(f"{self.log}/{part}")
        state = written(self.digests(since, until), "dedup-state")
        # On hits the full bytes decide.
        hits = state.filter("group_size > 1")
        own = joined_by_weight(fed.select("digest", "id", "content"), hits.select("digest", "group_size"), "digest", "group_size")
        # Equal contents are merged by task before they are compared, so the copies of one text cost a row for each task.
        classes = own.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("rows")).select("digest", "content")
        earlier = hits.filter(F.col("origin.part") < part)
        named = [r[0] for r in earlier.select("origin.part").distinct().collect()]  # as many as there were feeds
        if named:
            there = earlier.select("digest", "origin.part", F.col("origin.id").alias("first"))
            kept = self._parts(named).join(there, ["digest", "part"]).filter(F.col("id").eqNullSafe(F.col("first"))).select("digest", "content")
            classes = classes.unionByName(kept).distinct()
        found = written(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest"), "dedup-clashes")
        known = self._known_clashes(part)
        # what earlier feeds remembered holds for all contents of a digest, not only for the first
        clashing = found if known is None else found.unionByName(known.join(state, "digest", "left_semi")).distinct()
        verdicts = joined_by_weight(fed.select("id", "digest"), state.select("digest", "keep_id", "group_size"), "digest", "group_size")
        if not clashing.isEmpty():  # different contents with one digest: their rows are grouped by content alone, over the log up to this feed
            if not found.isEmpty():
                found.write.mode("overwrite").parquet(f"{self.clashes}/{part}")
            upto = [x for x in list_names(spark, self.log) if x.startswith("part=") and x <= part]
            whole = self._parts(upto).drop("part").join(clashing, "digest", "left_semi")
            apart = whole.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            verdicts = verdicts.join(clashing, "digest", "left_anti").unionByName(
                fed.join(clashing, "digest", "left_semi").join(apart, ["digest", "content"]).select("digest", "id", "keep_id", "group_size")
            )
        return verdicts.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batches: int = 4
) -> DataFrame:
    """One row per input row: id, keep_id (smallest id among equal texts), group_size, kept, digest. The state is not kept."""
    spark = docs.sparkSession
    with temporary(spark) as keep:
        found = DedupState(spark, new_path(spark, "dedup"), digest, batches).feed(docs, id_col, text_col)
        return written_at(found, keep(new_path(spark, "dedup-verdicts")))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows given twice, one."""
    found = exact_duplicates(docs, id_col, text_col)
    kept = found.filter("kept").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    out = filtered(docs, id_col, kept.filter("times = 1"), "left_semi")
    repeated = kept.filter("times > 1")
    digest = fresh(docs, "__digest")
    own = sha256(normalised(text_or_empty(text_col)))
    if not repeated.isEmpty():
        # one identifier on several staying rows: the same text twice, or different texts
        marked = filtered(docs, id_col, repeated, "left_semi").withColumn(digest, own)
        out = out.unionByName(marked.dropDuplicates([id_col, digest]).drop(digest))
    dropped = found.filter("not kept").select("id", "digest").distinct()
    mixed = dropped.join(kept, "id", "left_semi")
    if not mixed.isEmpty():
        # an identifier of which one text stays and another goes
        name = fresh(docs, "__id")
        gone = mixed.select(F.col("id").alias(name), F.col("digest").alias(digest))
        out = out.join(gone, (F.col(id_col).cast("long") == F.col(name)) & (own == F.col(digest)), "left_anti")
    return out
