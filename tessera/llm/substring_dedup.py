"""Substring deduplication by super-k-mers.

Every window of ``size`` words has a minimiser: the smallest hash of its runs of ``seed_words`` words, so equal windows have equal minimisers.
Consecutive windows of a document that share one are a super-k-mer, and travel to the minimiser's bucket as one packed string of words.

1. Texts with equal words are one: of all but the smallest identifier's every window is known to start earlier.
2. Of the others only places are stored: minimiser, first window, number of windows. Minimisers of one document alone
   send nothing.
3. Buckets of up to ``bucket_bytes`` of strings are one group of a task. Its words become numbers, and windows are sorted by ranks that double their length:
   equal ranks are equal words, not only equal digests.
   The windows of larger buckets are sorted by all tasks together, as 128-bit digests dealt by ranges of (window, identifier), so no bucket and no window is
   one task's whatever its size; of a window that begins in an earlier range the smallest identifier is looked up, one window a range. No window is left out
   on either way.
4. A document's found windows come back as spans of words, and its words outside them remain.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have none, and texts of fewer than ``size`` words no window. Rows without identifier come after
all others: they lose what any numbered document has, and take nothing from others. A row given twice is judged as once, and
rows of one identifier do not take from each other. An empty table gives an empty table; clashing column names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import joined_by_weight, new_path, slices, temporary, text_or_empty, written, written_at
from .words import ORDER, U, mixed, word_hashes

#: A super-k-mer of more windows (repeated words) is cut, so that a string is of bounded length.
LONGEST = 512


def words_of(text: str) -> Column:
    """The words of a text joined by one space."""
    return F.btrim(F.regexp_replace(text_or_empty(text), "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it, of words joined by one space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = np.flatnonzero(data == 32)
    return np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))


def smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def super_kmers(words: np.ndarray, owner: np.ndarray, size: int, seed_words: int) -> tuple[np.ndarray, ...]:
    """Minimiser, first window (a place in ``words``) and number of windows of each; ``owner`` is the text of each word, ascending."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = words[: len(words) - seed_words + 1] * ORDER[0]
    for k in range(1, seed_words):
        runs = runs + words[k : len(words) - seed_words + 1 + k] * ORDER[k]
    least = smallest(mixed(runs + U(seed_words)), size - seed_words + 1)
    whole = owner[:n] == owner[size - 1 :]  # windows that lie in one text
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    pieces = -(-length // LONGEST)
    if pieces.max() > 1:
        within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(np.repeat(length, pieces) - within * LONGEST, LONGEST)
        first = np.repeat(first, pieces) + within * LONGEST
    return least[first].view(np.int64), at[first], length


PLACE = "struct<minimiser: bigint, first: int, n: int, bytes: bigint>"
PLACES = pa.list_(pa.struct([("minimiser", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("bytes", pa.int64())]))


def _scan(size: int, seed_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                texts = [t.encode() for t in part.column(1).to_pylist()]
                data = np.frombuffer(b" ".join(texts), np.uint8)
                # an empty text still has its place between two spaces: an empty word, which is dropped
                first, end = word_places(data)
                bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
                first, end = first[first < end], end[first < end]
                owner = np.searchsorted(bounds, first, side="right") - 1
                before = np.searchsorted(owner, np.arange(len(texts) + 1))
                minimiser, at, n = super_kmers(word_hashes(data, first, end), owner, size, seed_words)
                whose = owner[at] if len(at) else np.zeros(0, np.int64)
                cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
                n_bytes = end[at + n + size - 2] - first[at] if len(at) else n
                columns = (pa.array(minimiser, pa.int64()), pa.array(at - before[whose], pa.int32()), pa.array(n, pa.int32()), pa.array(n_bytes, pa.int64()))
                places = pa.StructArray.from_arrays(columns, names=["minimiser", "first", "n", "bytes"])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), places)
                counts = pa.array(np.diff(before), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), counts, lists.cast(PLACES)], names=["id", "digest", "n_words", "places"])

    return scan


def _windows(data: bytes, first: np.ndarray, end: np.ndarray, at: int, n: int, size: int) -> Iterator[bytes]:
    return (data[a:b] for a, b in zip(first[at : at + n].tolist(), end[at + size - 1 : at + n + size - 1].tolist()))


def _sent(size: int):
    """Packed strings of documents with the places that travel."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for id_, digest, text, places in zip(*(part.column(k).to_pylist() for k in range(4))):
                    data = text.encode()
                    first, end = word_places(np.frombuffer(data, np.uint8))
                    for p in places:
                        rows[0].append(p["minimiser"])
                        rows[1].append(id_)
                        rows[2].append(digest)
                        rows[3].append(p["first"])
                        rows[4].append(data[first[p["first"]] : end[p["first"] + p["n"] + size - 2]])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()))], names=["minimiser", "id", "digest", "first", "packed"])

    return pack


SPAN_TYPES = (pa.int64(), pa.binary(), pa.int32(), pa.int32())


def window_ranks(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` codes, the same for equal runs only: lengths double, and the binary digits of ``size`` say which are joined."""

    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        n = len(b) - shift
        return np.unique(a[:n] * (int(b.max()) + 1) + b[shift:], return_inverse=True)[1]

    power, length, out, have = codes, 1, None, 0
    while True:
        if size & length:
            out, have = (power, length) if out is None else (joined(out, power, have), have + length)
        if have == size:
            return out
        power, length = joined(power, power, length), 2 * length


def _found_in(rows: list[tuple], size: int) -> list[tuple]:
    """Spans of words that windows of smaller identifiers cover: of super-k-mers (id, digest, first, packed) of whole buckets."""
    words = b" ".join([r[3] for r in rows]).split(b" ")
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    length = np.array([r[3].count(b" ") + 1 for r in rows])
    begin = np.cumsum(length) - length
    rank = window_ranks(codes, size)
    n = length - size + 1
    owner = np.repeat(np.arange(len(rows)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    rank = rank[begin[owner] + within]
    known = sorted({r[0] for r in rows if r[0] is not None})
    place = {x: k for k, x in enumerate(known)}
    order = np.array([place.get(r[0], len(known)) for r in rows])[owner]  # rows without identifier come last
    least = np.full(int(rank.max()) + 1, len(known))
    np.minimum.at(least, rank, order)
    hit = np.flatnonzero(least[rank] < order)
    if not len(hit):
        return []
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(hit)) - 1
    return [(*rows[k][:2], rows[k][2] + a, rows[k][2] + b + size) for k, a, b in zip(owner[hit[starts]].tolist(), within[hit[starts]].tolist(), within[hit[ends]].tolist())]


def _buckets(size: int, together: int = 1 << 20):
    """Spans found in the rows of a task, sorted by minimiser; whole buckets are taken together up to some bytes."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_bytes, now = [], 0, None
        for batch in batches:
            for part in slices(batch, 2000):
                for minimiser, *row in zip(*(c.to_pylist() for c in part.columns)):
                    if minimiser != now and n_bytes >= together:
                        yield _spans(_found_in(held, size))
                        held, n_bytes = [], 0
                    now = minimiser
                    held.append(tuple(row))
                    n_bytes += len(row[3])
        yield _spans(_found_in(held, size) if held else [])

    return spans


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SPAN_TYPES)], names=["id", "digest", "first", "end"])


def _digests(size: int):
    """The windows of large buckets, one by one."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                ids, digests, places, keys = [], [], [], []
                for id_, digest, text, spans in zip(*(part.column(k).to_pylist() for k in range(4))):
                    data = text.encode()
                    first, end = word_places(np.frombuffer(data, np.uint8))
                    for p in spans:
                        n = p["n"]
                        ids += [id_] * n
                        digests += [digest] * n
                        places += range(p["first"], p["first"] + n)
                        keys += (blake2b(w, digest_size=16).digest() for w in _windows(data, first, end, p["first"], n, size))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, digests, places, keys), (pa.int64(), pa.binary(), pa.int32(), pa.binary()))], names=["id", "digest", "first", "window"])

    return windows


def _found_by_sorting(found: DataFrame, size: int) -> DataFrame:
    """Spans of the windows (id, digest, first, window) that a smaller identifier has too."""
    dealt = written(found.repartitionByRange("window", "id").withColumn("range", F.spark_partition_id()), "kmer-ranges")
    begun = dealt.groupBy("range").agg(F.min("window").alias("window")).select("window").distinct()  # one a range
    lows = dealt.join(F.broadcast(begun), "window", "left_semi").groupBy("window").agg(F.min("id").alias("low")).collect()
    known = {bytes(x["window"]): x["low"] for x in lows if x["low"] is not None}

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, digest, first, window, low in zip(*(c.to_pylist() for c in batch.columns)):
                least = known.get(window, low)  # over all ranges where a window is in several
                if least is not None and (id_ is None or least < id_):
                    out.append((id_, digest, first, first + size))
            yield _spans(out)

    in_range = F.min("id").over(Window.partitionBy("range", "window"))
    return dealt.select("id", "digest", "first", "window", in_range.alias("low")).mapInArrow(later, "id long, digest binary, first int, end int")


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of texts whose spans are known."""
    for batch in batches:
        for part in slices(batch, 256):
            removed, kept = [], []
            for text, spans in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = text.split(" ")
                edges = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edges[s["first"]] += 1
                    edges[s["end"]] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(" ".join(words[k] for k in np.flatnonzero(~gone)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "digest", "n_removed", "kept_text"])


def repeated_passages(
    docs: DataFrame, size: int = 50, seed_words: int = 8, bucket_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (its words, joined by one space; null where nothing was removed, empty where all was), digest
    (SHA-256 of all its words so joined)."""
    spark = docs.sparkSession
    with temporary(spark) as keep_path:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), words_of(text_col).alias("text"))
        texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
        # the words' hashes serve to find minimisers only: windows are compared by their words
        scanned = written(texts.select("id", "text", "digest").mapInArrow(_scan(size, seed_words), f"id long, digest binary, n_words long, places array<{PLACE}>"), "kmer-places")
        equal = scanned.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("times"))
        first = written(joined_by_weight(scanned.select("digest", "id", "n_words"), equal, "digest", "times"), "kmer-rows")

        # one row for each text: the first identifier with its words
        alone = scanned.filter(F.size("places") > 0).groupBy("digest").agg(F.min("id").alias("id"), F.first("places").alias("places"))
        placed = written(alone.select("id", "digest", F.explode("places").alias("p")).select("id", "digest", "p.*"), "kmer-alone")
        nulls = F.max(F.col("id").isNull())
        buckets = placed.groupBy("minimiser").agg(F.min("id").alias("low"), F.max("id").alias("high"), nulls.alias("nulls"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("times"))
        shared = written(buckets.filter("low < high OR nulls AND low IS NOT NULL").select("minimiser", F.col("bytes").alias("bucket"), "times"), "kmer-buckets")
        sent = joined_by_weight(placed, shared, "minimiser", "times")
        place = F.struct("minimiser", "first", "n")
        large = F.col("bucket") > bucket_bytes
        lists = sent.groupBy("id", "digest").agg(F.collect_list(F.when(~large, place)).alias("small"), F.collect_list(F.when(large, place)).alias("large"))
        words = texts.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "text")
        asked = words.join(lists, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__digest") == F.col("digest")))
        if not first.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
            asked = asked.dropDuplicates(["id", "digest"])  # rows given twice
        asked = written(asked.select("id", "digest", "text", "small", "large"), "kmer-texts")

        packed = asked.filter(F.size("small") > 0).select("id", "digest", "text", "small").mapInArrow(_sent(size), "minimiser long, id long, digest binary, first int, packed binary")
        spans = packed.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_buckets(size), "id long, digest binary, first int, end int")
        single = asked.filter(F.size("large") > 0).select("id", "digest", "text", "large")
        if not single.isEmpty():
            found = written(single.mapInArrow(_digests(size), "id long, digest binary, first int, window binary"), "kmer-windows")
            spans = spans.unionByName(_found_by_sorting(found, size))
        spans = spans.groupBy("id", "digest").agg(F.collect_list(F.struct("first", "end")).alias("spans")).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "spans")
        left = asked.select("id", "digest", "text").join(spans, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
        left = left.select("id", "digest", "text", "spans").mapInArrow(_remaining, "id long, digest binary, n_removed long, kept_text string")
        left = left.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "n_removed", "kept_text")

        later = F.col("keep_id").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("keep_id"))) & (F.col("n_words") >= size)
        out = first.join(left, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
        out = out.select(
            "id",
            "n_words",
            F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(later, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
            F.lower(F.hex("digest")).alias("digest"),
        )
        return written_at(out, keep_path(new_path(spark, "repeated-passages")))
