"""Typeahead: all words of the query must begin a word of the text, else the text must contain the query; then ranked. And names that are nearly known."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import like_literal, search_text
from ..functions.text import sequence_ratio, similarity
from ..sources.stored import written

#: Least score, least length of a word, most candidates that are scored.
LEAST_SCORE, LEAST_LENGTH, CANDIDATES = 0.30, 2, 500


def typeahead(df: DataFrame, column: str, asked: str, rank: str, limit: int = 20, candidates: int = CANDIDATES) -> DataFrame:
    """Rows whose ``column`` matches, by similarity, then ``rank`` descending, then the column. A top-k report: the ``candidates`` of the highest rank are scored."""
    spark = df.sparkSession
    normal = spark.range(1).select(search_text(F.lit(asked))).first()[0]
    words = list(dict.fromkeys(w for w in normal.split(" ") if len(w) >= LEAST_LENGTH))
    if not words:
        return df.limit(0).withColumn("score", F.lit(0.0))
    text = df.withColumn("__text", search_text(column))
    begins = reduce(lambda a, b: a & b, [F.concat(F.lit(" "), F.col("__text")).like(f"% {like_literal(w)}%") for w in words])
    order = [F.col(rank).desc_nulls_last(), F.col(column)]
    hits = text.filter(begins).orderBy(*order).limit(candidates)
    if hits.isEmpty():
        hits = text.filter(F.col("__text").contains(normal)).orderBy(*order).limit(candidates)
    scored = hits.withColumn("score", similarity(F.col("__text"), F.lit(normal))).filter(F.col("score") >= LEAST_SCORE)
    return scored.orderBy(F.col("score").desc(), *order).limit(limit).drop("__text")


def _characters(names: list[str], column: dict[tuple[str, int], int]) -> np.ndarray:
    """Names as rows of ones: a column for each character with how often it stood before, so that products of rows count common characters as multisets."""
    places = []
    for name in names:
        seen: dict[str, int] = {}
        for c in name:
            seen[c] = seen.get(c, 0) + 1
            if (c, seen[c]) in column:
                places.append(column[c, seen[c]])
        places.append(-1)
    places = np.array(places)
    out = np.zeros((len(names), len(column)), np.float32)
    inside = places >= 0
    out[np.cumsum(~inside)[inside], places[inside]] = 1
    return out


def _bounds(known: list[str], asked: list[str]) -> np.ndarray:
    """(asked, known) -> the most that the similarity can be: twice the common characters over all."""
    column: dict[tuple[str, int], int] = {}
    for name in asked:
        seen: dict[str, int] = {}
        for c in name:
            seen[c] = seen.get(c, 0) + 1
            column.setdefault((c, seen[c]), len(column))
    common = _characters(asked, column) @ _characters(known, column).T
    return 2.0 * common / np.add.outer([len(x) for x in asked], [len(x) for x in known])


#: Names that are looked at together, and characters of a name that fit a word of bits.
TOGETHER, WORD = 32, 64


def _points(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(name, place) -> code point and one more, 0 behind the end; and the lengths."""
    length = np.array([len(x) for x in names])
    width = max(int(length.max(initial=0)), 1)
    points = np.array(names, f"<U{width}").view(np.uint32).reshape(len(names), width).astype(np.int64) + 1
    return np.where(np.arange(width) < length[:, None], points, 0), length


class InOrder:
    """The most that similarity to known names can be: matched blocks stand in one order on both sides, so they are no more than the longest common subsequence.

    Subsequences are counted in words of bits, one for an asked name, which step through the known names' characters; known names come sorted, and a beginning that
    neighbours share is stepped through once. Of asked names longer than a word the rest counts as common.
    """

    def __init__(self, known: list[str]):
        points, self.length = _points(known)
        new, at, self.steps = np.zeros(len(known), bool), np.zeros(len(known), np.intp), []
        new[:1] = True
        for j in range(points.shape[1]):
            new[1:] |= points[1:, j] != points[:-1, j]
            first = np.flatnonzero(new)
            self.steps.append((at[first], points[first, j]))  # of each beginning: the one that is shorter by a character, and that character
            at = np.cumsum(new) - 1
        self.last = at

    def bounds(self, asked: list[str]) -> Iterator[np.ndarray]:
        """(asked, known) -> bound, for ``TOGETHER`` asked names at a time."""
        points, length = _points(asked)
        own = np.unique(points)
        own = own[own > 0]
        places = [np.where(own[np.minimum(np.searchsorted(own, p), len(own) - 1)] == p, np.searchsorted(own, p), len(own)) for _, p in self.steps] if len(own) else [np.zeros(len(p), np.intp) for _, p in self.steps]
        for k in range(0, len(asked), TOGETHER):
            some, long = points[k : k + TOGETHER, :WORD], length[k : k + TOGETHER]
            bits, rows = np.zeros((len(some), len(own) + 1), np.uint64), np.arange(len(some))
            for j in range(some.shape[1]):
                inside = some[:, j] > 0
                bits[rows[inside], np.searchsorted(own, some[inside, j])] |= np.uint64(1 << j)
            open_ = np.full((len(some), 1), 2**64 - 1, np.uint64)
            for (before, _), place in zip(self.steps, places):
                open_ = open_.take(before, 1)
                hit = open_ & bits.take(place, 1)
                open_ = (open_ + hit) | (open_ - hit)
            low = np.array([(1 << min(int(n), WORD)) - 1 for n in long], np.uint64)
            common = np.bitwise_count(~open_ & low[:, None]).take(self.last, 1) + np.maximum(long - WORD, 0)[:, None]
            yield 2.0 * np.minimum(common, self.length) / np.maximum(np.add.outer(long, self.length), 1)


#: Names of a block; a task compares one block of asked names with one of known ones.
BLOCK = 2048


def _blocks(names: DataFrame, *columns: str) -> DataFrame:
    """Names and what belongs to them in arrays of about ``BLOCK``."""
    n = max(1, -(-names.count() // BLOCK))
    each = F.sort_array(F.collect_list(F.struct("name", *columns)), asc=False)
    return names.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).alias("block")).agg(each.alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in ("name", *columns)])


def _meeting(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Every block of known names beside every one of asked names, a row each, over all tasks."""
    pairs = known.withColumnRenamed("name", "known").crossJoin(asked)
    return pairs.repartition(4 * known.sparkSession.sparkContext.defaultParallelism)


def _named(names: DataFrame) -> DataFrame:
    return names.select("name").filter("name <> ''").distinct()


def close_pairs(known: DataFrame, asked: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (known, asked) of names whose similarity can reach the cutoff, with the most that it can be (``bound``).

    Similarity is twice the matched characters over all, so at most twice the common characters, as multisets: products of matrices, a block of names by a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds = _bounds(row["known"], row["name"])
                a, k = np.nonzero(bounds >= cutoff - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([row["known"][j] for j in k], pa.string()), pa.array([row["name"][i] for i in a], pa.string()), pa.array(bounds[a, k], pa.float64())], names=["known", "asked", "bound"])

    return _meeting(_blocks(_named(known)), _blocks(_named(asked))).mapInArrow(run, "known string, asked string, bound double")


def _likely(known: DataFrame, asked: DataFrame, cutoff: float, most: int) -> DataFrame:
    """Of each asked name and block of known ones the ``most`` whose similarity can be highest, if it can reach the cutoff, the greater name first among equals: known, asked, bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, asked_names, found = row["known"], row["name"], []  # known names come in descending order
                first = 0
                for bounds in InOrder(names).bounds(asked_names):
                    rows = np.arange(len(bounds))
                    for _ in range(min(most, len(names))):
                        best = bounds.argmax(1)
                        found.append((rows + first, best, bounds[rows, best]))
                        bounds[rows, best] = -1.0
                    first += len(bounds)
                a, k, bound = (np.concatenate(x) for x in zip(*found))
                use = bound >= cutoff - 1e-9
                yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in k[use]], pa.string()), pa.array([asked_names[i] for i in a[use]], pa.string()), pa.array(bound[use], pa.float64())], names=["known", "asked", "bound"])

    return _meeting(_blocks(_named(known)), _blocks(_named(asked))).mapInArrow(run, "known string, asked string, bound double")


def _best_of_blocks(known: DataFrame, asked: DataFrame, cutoff: float, n: int) -> DataFrame:
    """For each asked name and block of known ones the ``n`` most similar: asked, known, score. asked: (name, least), a score below which nothing is wanted.

    Pairs are compared by falling bound, until none can come among the n best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                least, found = np.maximum(row["least"], cutoff) - 1e-9, []
                bounds = (bound for some in InOrder(row["known"]).bounds(row["name"]) for bound in some)
                for name, enough, bound in zip(row["name"], least, bounds):
                    near = np.flatnonzero(bound >= enough)
                    if not len(near):
                        continue
                    matcher, best = SequenceMatcher(None, "", name), []
                    for j in near[np.argsort(-bound[near], kind="stable")]:
                        if len(best) == n and bound[j] < best[0][0] - 1e-9:
                            break
                        matcher.set_seq1(row["known"][j])
                        score = matcher.ratio()
                        if score >= cutoff:
                            (heapq.heappush if len(best) < n else heapq.heappushpop)(best, (score, row["known"][j]))
                    found += [(name, k, score) for score, k in best]
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["asked", "known", "score"])

    return _meeting(_blocks(_named(known)), _blocks(asked, "least")).mapInArrow(run, "asked string, known string, score double")


def closest_names(known: DataFrame, asked: DataFrame, cutoff: float = 0.8, n: int = 1, first: int = 4) -> DataFrame:
    """For each asked name the ``n`` most similar known ones that reach the cutoff, the greater name first among equals: asked, known, score, place. known, asked: (name).

    Characters count as they are. Empty names match nothing. Of the pairs that can reach the cutoff the ``first`` of the highest bound are compared; of the others only
    those whose bound is not below the n-th best score that these gave.
    """
    from ..functions.windows import top_n_per_group

    first = max(first, n)
    pairs = top_n_per_group(_likely(known, asked, cutoff, first), ["asked"], [F.desc("bound"), F.desc("known")], first)
    tried = pairs.withColumn("score", sequence_ratio(F.col("known"), F.col("asked")))
    reached = tried.groupBy("asked").agg(F.get(F.sort_array(F.collect_list(F.when(F.col("score") >= cutoff, F.col("score"))), asc=False), F.lit(n - 1)).alias("least"))  # of ``first`` numbers
    wanted = written(reached.select(F.col("asked").alias("name"), F.coalesce("least", F.lit(cutoff)).alias("least")), "names-asked")
    best = [F.col("score").desc(), F.col("known").desc()]
    found = top_n_per_group(_best_of_blocks(known, wanted, cutoff, n), ["asked"], best, n)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(*best)).cast("long"))


def known_or_close(known: DataFrame, asked: DataFrame, cutoffs: tuple[float, float] = (0.8, 0.55), n: int = 10) -> DataFrame:
    """asked, rung, place, known, score: a known name but for case and spaces around it stands for itself; else the most similar from the first cutoff on;
    else up to ``n`` from the second on. Names that find nothing have one row, of rung ``none``."""
    asked = asked.select("name").filter("name is not null").distinct()
    same = known.select(F.lower(F.trim("name")).alias("key"), F.col("name").alias("known")).groupBy("key").agg(F.min("known").alias("known"))
    exact = asked.join(same, F.lower(F.trim("name")) == F.col("key")).select(F.col("name").alias("asked"), F.lit("exact").alias("rung"), F.lit(1).cast("long").alias("place"), "known", F.lit(1.0).alias("score"))
    rest, rows = asked, written(exact, "names-known")
    found = [rows]
    for rung, cutoff, most in (("close", cutoffs[0], 1), ("alike", cutoffs[1], n)):
        rest = rest.join(rows.select(F.col("asked").alias("name")).distinct(), "name", "left_anti")
        rows = written(closest_names(known, rest, cutoff, most).select("asked", F.lit(rung).alias("rung"), "place", "known", "score"), "names-close")
        found.append(rows)
    none = rest.join(rows.select(F.col("asked").alias("name")).distinct(), "name", "left_anti")
    found.append(none.select(F.col("name").alias("asked"), F.lit("none").alias("rung"), F.lit(1).cast("long").alias("place"), F.lit(None).cast("string").alias("known"), F.lit(None).cast("double").alias("score")))
    return reduce(DataFrame.unionByName, found)
