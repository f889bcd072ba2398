"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as runs of small shards: Parquet files that are never changed. A tier holds runs of similar size, each
up to ``fanout`` times the tier below. When a tier has ``fanout`` runs, they are merged into one run of files of about the
target size; the tasks read whole shards and write one file each, so merging needs no shuffle.

Every write goes to a folder of its own, named by a UUID, and nothing is ever overwritten. A change takes effect when the
next version of the manifest is committed: a list of runs with tier, bytes, rows and files, so its length grows with the
logarithm of the data. The manifest is written in a folder aside, which is then renamed to its number. The rename is the only
judge between writers: it must move a folder in one step and never replace one that is there, as HDFS and POSIX file systems
do (both leave the first folder in place; the file read back says who won). Object stores without an atomic rename
are not suited. Who loses reads the new version and commits again on top of it: an append always can; a merge does if its runs are
still there, else it deletes what it wrote and plans anew. Readers see all or nothing of a change; a job that dies leaves only
folders that no manifest names, which ``vacuum`` deletes a day later. The data path is DataFrame operations only.

Rows are kept as they are: nulls, empty texts and rows given twice. An append without rows commits nothing. A column
``__shard`` of the data (in any case) is refused, as reading adds it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Run(NamedTuple):
    name: str
    tier: int
    bytes: int
    rows: int
    files: int


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, small_bytes: int = 16 << 20, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.small_bytes, self.fanout = target_bytes, small_bytes, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("manifests", "runs"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    # The manifest.

    def _listed(self, path: str) -> list[Any]:
        return list(self._fs.listStatus(self._path(path)))

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self._listed(f"{self.root}/manifests"))
        return sorted(int(x) for x in names if x.isdigit())

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}"

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """version, writer and runs of a version, the latest by default."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "writer": "", "runs": []}
        stream = self._fs.open(self._path(f"{self._manifest_path(version)}/manifest.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return found | {"runs": [Run(*x) for x in found["runs"]]}

    def commit(self, base: dict[str, Any], runs: list[Run]) -> dict[str, Any]:
        """Make ``runs`` the version after ``base``; raises Conflict if there is one already."""
        new = {"version": base["version"] + 1, "writer": uuid.uuid4().hex, "runs": runs}
        aside = f"{self.root}/manifests/.{new['writer']}"
        out = self._fs.create(self._path(f"{aside}/manifest.json"), False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        at = self._manifest_path(new["version"])
        self._fs.rename(self._path(aside), self._path(at))
        if self.manifest(new["version"])["writer"] != new["writer"]:
            for lost in (aside, f"{at}/.{new['writer']}"):  # where a rename onto a folder leaves the loser's
                self._fs.delete(self._path(lost), True)
            raise Conflict(new["version"])
        return new

    # Data.

    def _run_path(self, name: str) -> str:
        return f"{self.root}/runs/{name}"

    def _write_run(self, rows: DataFrame) -> Run:
        """A run in a new folder, of tier 0 until it is placed."""
        name = uuid.uuid4().hex
        rows.write.parquet(self._run_path(name))
        sizes = [x.getLen() for x in self._listed(self._run_path(name)) if x.getPath().getName().endswith(".parquet")]
        n = self.spark.read.schema(rows.schema).parquet(self._run_path(name)).count()  # from the files' footers
        return Run(name, 0, sum(sizes), n, len(sizes))

    def _tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(1, size) / self.small_bytes, self.fanout)))

    def append(self, rows: DataFrame) -> dict[str, Any]:
        """Add rows as one run of small shards, one for each task that has rows."""
        if "__shard" in (c.lower() for c in rows.columns):
            raise ValueError("a column __shard is not allowed")
        run = self._write_run(rows)
        if not run.rows:
            self._fs.delete(self._path(self._run_path(run.name)), True)
            return self.manifest()
        run = run._replace(tier=self._tier(run.bytes))
        while True:
            base = self.manifest()
            try:
                return self.commit(base, [*base["runs"], run])
            except Conflict:
                continue  # an append holds on top of any version

    def compact(self) -> dict[str, Any]:
        """Merge tiers that are full until none is, a version for each merge."""
        while True:
            base = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for x in base["runs"]:
                tiers.setdefault(x.tier, []).append(x)
            full = min((t for t, runs in tiers.items() if len(runs) >= self.fanout), default=None)
            if full is None:
                return base
            old = tiers[full][: self.fanout]  # the oldest: runs stand in the order of their commits
            size = sum(x.bytes for x in old)
            rows = self.spark.read.option("mergeSchema", "true").parquet(*(self._run_path(x.name) for x in old))
            merged = self._write_run(rows.coalesce(max(1, round(size / self.target_bytes))))
            merged = merged._replace(tier=max(full + 1, self._tier(size)))
            while set(old) <= set(base["runs"]):
                try:
                    self.commit(base, [*(x for x in base["runs"] if x not in old), merged])
                    break
                except Conflict:
                    base = self.manifest()
            else:  # another writer has merged some of them
                self._fs.delete(self._path(self._run_path(merged.name)), True)

    def vacuum(self, keep: int = 2, orphan_hours: float = 24) -> None:
        """Keep the latest ``keep`` versions: delete older manifests and the runs that only they name.

        Folders that no manifest names are deleted when they are older than ``orphan_hours``, as they may be another writer's.
        """
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        used = {x.name for v in kept for x in self.manifest(v)["runs"]}
        retired = {x.name for v in old for x in self.manifest(v)["runs"]} - used
        before = (time.time() - orphan_hours * 3600) * 1000
        for x in self._listed(f"{self.root}/runs"):
            name = x.getPath().getName()
            if name in retired or (name not in used and x.getModificationTime() < before):
                self._fs.delete(x.getPath(), True)
        for v in old:
            self._fs.delete(self._path(self._manifest_path(v)), True)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the shard they are in (run/file) as ``__shard``."""
        runs = self.manifest(version)["runs"]
        if not runs:
            raise ValueError("the store is empty")
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(self._run_path(x.name) for x in runs))
        return rows.withColumn("__shard", F.substring_index(F.input_file_name(), "/", -2))


def sharded(docs: DataFrame, root: str, arrivals: int = 4, id_col: str = "doc_id", **settings: Any) -> ShardStore:
    """Append ``docs`` in ``arrivals`` parts (by a hash of the identifier; null in one of them), compacting after each."""
    store = ShardStore(docs.sparkSession, root, **settings)
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("arrival")), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.filter(part == k))
        store.compact()
        store.vacuum()
    return store
