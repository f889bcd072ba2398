"""Intermediate tables in a folder that the driver and all executors can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: The paths made inside each open ``temporary``.
_open: list[list[str]] = []
#: Shared tables by key, the oldest first: frame, path and time. How long they stand, and how many.
_shared: dict[Hashable, tuple[DataFrame, str, float]] = {}
SHARED_SECONDS, SHARED_MOST = 6 * 3600, 256


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only in local mode, where it is unset, a temporary one until the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[str], str]]:
    """What is stored inside is deleted at the end, but for paths given to the function that this yields: they belong to the context around."""
    made: list[str] = []
    kept: list[str] = []
    _open.append(made)

    def keep(path: str) -> str:
        kept.append(path)
        return path

    try:
        yield keep
    finally:
        _open.pop()
        for path in made:
            if path not in kept:
                drop_path(spark, path)
        if _open:
            _open[-1].extend(kept)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: what follows neither repeats nor loses its work."""
    return written_at(df, new_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(spark: SparkSession, paths: Sequence[str]) -> tuple[int, int, int]:
    """What tells the files under some paths from others: their number, bytes, and a sum over path, length and time. Tasks list them, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    one = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("hash")).first()
    return one["n"], one["size"] or 0, one["hash"] or 0


def shared_table(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """A derived table, made once for a key and kept as Parquet in the shared folder for all that ask for it in this application.

    The key must say all that the table depends on, the signature of its inputs among it. Tables go when they are ``SHARED_SECONDS`` old or ``SHARED_MOST`` younger ones
    are there; what still reads one then has to be made anew.
    """
    key = (spark.sparkContext.applicationId, shared_dir(spark), *key)
    now = time.monotonic()
    for k, (_, path, made) in list(_shared.items()):
        if now - made > SHARED_SECONDS or len(_shared) > SHARED_MOST:
            del _shared[k]
            if k[0] == key[0]:
                drop_path(spark, path)
    found = _shared.get(key)
    if found and "_SUCCESS" in list_names(spark, found[1]):
        return found[0]
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"  # not one of a ``temporary`` around
    _shared[key] = (written_at(make(), path), path, now)
    return _shared[key][0]


def forget_shared(spark: SparkSession) -> None:
    """Delete the shared tables of this application."""
    for key in [k for k in _shared if k[0] == spark.sparkContext.applicationId]:
        drop_path(spark, _shared.pop(key)[1])


def file_system(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_path``."""
    target, fs = file_system(spark, path)
    fs.delete(target, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    target, fs = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to one that must not exist."""
    (a, fs), (b, _) = file_system(spark, source), file_system(spark, target)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(target)


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; it must not exist."""
    target, fs = file_system(spark, path)
    out = fs.create(target, False)
    out.write(bytearray(text.encode()))
    out.close()
