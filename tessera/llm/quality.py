"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are estimated: of the raw text, counted over all documents, and of the target,
counted over those of a bounded sample of labelled rows that are labelled good. The n-grams are the words of the text as they
stand, its pairs of words (a word that repeats the one before it counts as the token of repetition), and its runs of three bytes. A
document's log importance weight is the sum of log(target / raw) over its n-grams; of a document with more than ``evidence``
n-grams, their mean times ``evidence``, as the n-grams of a long text are far from independent. Gumbel noise, fixed by the identifier, is added, and the k largest
are drawn without replacement. Unless k is given, it is the number of documents whose weight is beyond the cut that parts
the good and bad labelled rows with the least errors (good ones weighed by a target model without their own n-grams).

The k-th largest is found by counting in ever finer bins, so nothing is ranked in one task. Rows that tie with it stay, and
so do both of two equal rows with one identifier. Null, empty and blank texts have no n-grams and are rejected. Without
labelled rows of both kinds nothing can be learned and every document stays with weight 0. Of several labels of one
identifier the lowest counts; labels without identifier or other than 0 and 1 are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, slices, temporary, written
from .words import NOT_SPACE, U, mixed, word_hashes, word_spans

BITS = 14
BUCKETS = 1 << BITS
#: The weight of a text without words.
LEAST = -1e6
AGAIN, FACTOR = U(7), U(0x9E3779B97F4A7C15)


def ngrams(text: str | None) -> np.ndarray:
    """Bucket numbers of all n-grams of the text: words, pairs of words, runs of three bytes."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    first, end = word_spans(data, NOT_SPACE)
    if not len(first):
        return np.zeros(0, np.intp)
    words = word_hashes(data, first, end)
    words[1:][words[1:] == words[:-1]] = AGAIN
    padded = np.full(len(data) + 2, 32, U)
    padded[1:-1] = data
    runs = padded[:-2] << U(16) | padded[1:-1] << U(8) | padded[2:]
    return np.concatenate([(mixed(x) >> U(64 - BITS)).astype(np.intp) for x in (words, words[1:] * FACTOR + words[:-1], runs + U(1 << 32))])


def log_share(counts: np.ndarray, total: float) -> np.ndarray:
    """Logs of the smoothed shares of buckets with these counts."""
    return np.log((counts + 0.5) / (total + 0.5 * BUCKETS))


def of_sum(total: float, n: float, evidence: float) -> float:
    return total * min(1.0, evidence / n)


class QualityModel(NamedTuple):
    ratio: np.ndarray | None  # log ratio of each bucket; None: nothing could be learned
    cut: float
    evidence: float

    def weight(self, text: str | None) -> float:
        if self.ratio is None:
            return 0.0
        found = ngrams(text)
        return of_sum(float(self.ratio[found].sum()), len(found), self.evidence) if len(found) else LEAST


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the range of cuts with the least number of good weights below plus bad ones from it on."""
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    errors = np.searchsorted(np.sort(good), cuts) + len(bad) - np.searchsorted(np.sort(bad), cuts)
    best = np.flatnonzero(errors == errors.min())
    return float(cuts[best[len(best) // 2]])


COUNTS = "bucket bigint, n bigint, n_good bigint, quality int, found array<bigint>, counts array<bigint>"


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, evidence: float = 200) -> QualityModel:
    """``docs`` (id, text), ``labels`` (id, quality: 1 good, 0 bad). Raw counts are over all documents; labelled are at most ``sample_rows``.

    The n-grams of labelled rows stay in a stored table; the driver gets counts by bucket and one weight for each labelled row.
    """
    known = labels.filter("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["bucket", "n", "n_good", "quality", "found", "counts"]
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text, quality in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.bincount(ngrams(text), minlength=BUCKETS)
                total += counts
                if quality is not None:
                    good += quality * counts
                    found = np.flatnonzero(counts)
                    rows.append((None, None, None, quality, found, counts[found]))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
        found = np.flatnonzero(total)
        none = [None] * len(found)
        yield pa.record_batch([pa.array(x, t) for x, t in zip((found, total[found], good[found], none, none, none), types, strict=True)], names=names)

    counted = written(docs.join(F.broadcast(drawn.withColumnRenamed("id", "labelled")), F.col("id") == F.col("labelled"), "left").select("text", F.col("quality").cast("int")).mapInArrow(count, COUNTS), "ngram-counts")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, n_good in counted.filter("bucket is not null").groupBy("bucket").agg(F.sum("n"), F.sum("n_good")).collect():  # at most BUCKETS rows
        raw[bucket], target[bucket] = n, n_good
    base, n_target = log_share(raw, raw.sum()), target.sum()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for q, found, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found, counts = np.array(found, np.intp), np.array(counts, float)
                own = log_share(target[found] - q * counts, n_target - q * counts.sum())
                weights.append(of_sum(float((own - base[found]) @ counts), counts.sum(), evidence))
            yield pa.record_batch([batch.column(0), pa.array(weights, pa.float64())], names=["quality", "weight"])

    labelled = counted.filter("quality is not null and size(found) > 0").select("quality", "found", "counts")
    weights = labelled.mapInArrow(weigh, "quality int, weight double").collect()  # at most sample_rows rows, more where identifiers are repeated
    good, bad = (np.array([w for q, w in weights if q == k]) for k in (1, 0))
    if not len(good) or not len(bad):
        return QualityModel(None, 0.0, evidence)
    return QualityModel(log_share(target, n_target) - base, best_cut(good, bad), evidence)


def log_weight(model: QualityModel, text: Column) -> Column:
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.weight(x) for part in slices(batch) for x in part.to_pylist()], pa.float64())

    return F.arrow_udf(weigh, "double")(text)


def gumbel_key(weight: Column, identifier: Column) -> Column:
    """The weight with Gumbel noise fixed by the identifier."""
    u = (F.pmod(F.xxhash64(identifier, F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value of a stored table, by counts in ever finer bins (``bins`` numbers to the driver each time)."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while high > low:
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = rows.filter(F.col(column).between(low, high)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        if len(counts) == 1 and (high - low) / bins < 1e-15 * max(1.0, abs(high)):
            break
    return low


def resampled(docs: DataFrame, columns: list[str], labels: DataFrame, id_col: str, text_col: str, label_id_col: str, sample_rows: int, k: int | None) -> tuple[DataFrame, str, str, float]:
    """The stored ``columns`` of ``docs`` with their weights and keys, the names of both, and the least key drawn."""
    identifier, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    with temporary(docs.sparkSession):
        model = train(docs.select(identifier.alias("id"), text.alias("text")), labels.select(F.col(label_id_col).cast("long").alias("id"), "quality"), sample_rows)
    weight, key = fresh(docs, "__weight"), fresh(docs, "__key")
    scored = docs.withColumn(weight, log_weight(model, text)).withColumn(key, gumbel_key(F.col(weight), identifier))
    scored = written(scored.select(*columns, weight, key), "weights")
    if k is None:
        k = scored.filter(F.col(weight) >= model.cut).count()
    if model.ratio is None or scored.isEmpty():
        return scored, weight, key, float("-inf")
    least = kth_largest(scored, key, min(k, scored.count())) if k else float("inf")
    return scored, weight, key, least


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", sample_rows: int = 8000, k: int | None = None) -> DataFrame:
    """One row per input row: id, log_weight, key, kept."""
    rows, weight, key, least = resampled(docs, [id_col], labels, id_col, text_col, label_id_col, sample_rows, k)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(weight).alias("log_weight"), F.col(key).alias("key"), ((F.col(key) >= least) & (F.col(weight) > LEAST)).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", sample_rows: int = 8000, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; they are stored once with their keys, as the draw needs all keys."""
    rows, weight, key, least = resampled(docs, docs.columns, labels, id_col, text_col, label_id_col, sample_rows, k)
    return rows.filter((F.col(key) >= least) & (F.col(weight) > LEAST)).drop(weight, key)
