"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows. The weights are learned by follow-the-regularised-leader
(proximal, elastic net) on a bounded sample of them, drawn by a hash of the identifier, about the same number for each
language (``sample_rows`` over their number, ``least_rows`` at least); a part of the sample sets the temperature by which probabilities are calibrated.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is nothing to learn from.
Rows without a language or without an identifier are predicted, never learned from. Rows given twice are predicted twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, stream

BITS = 15
SIZE = 1 << BITS
MIX = stream(11, 4) | U(1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three characters that occur in the text, and how often."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32).astype(U) + U(1)
    key = c * MIX[0]
    counts = np.bincount((key >> U(64 - BITS)).astype(np.intp), minlength=SIZE)
    for n in (1, 2):
        key = (key[:-1] ^ (key[:-1] >> U(29))) * MIX[n] + c[n:] * MIX[3]
        counts += np.bincount((key >> U(64 - BITS)).astype(np.intp), minlength=SIZE)
    found = np.flatnonzero(counts)
    return found, counts[found]


class LanguageModel(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / np.sqrt(x @ x)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(found, counts) @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*ngram_counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from rows of (feature numbers, values, class)."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) > l1, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            found, x, y = rows[k]
            i, v = np.append(found, SIZE), np.append(x, 1.0)
            w = weights(i)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            squares = n[i] + g * g
            z[i] += g - (np.sqrt(squares) - np.sqrt(n[i])) / alpha * w
            n[i] = squares
    w = weights(slice(None))
    return w[:SIZE].astype(np.float32), w[SIZE]


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss, from 0.05 to 20."""
    if not len(classes):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    return float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(classes)), classes] + 1e-12).mean()))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of each hashed n-gram over all ``rows`` (text): in how many texts it is; and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if has_letter(text):
                    total[ngram_counts(text)[0]] += 1
                    total[SIZE] += 1
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found])], names=["ngram", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for ngram, n in rows.select("text").mapInArrow(count, "ngram bigint, n bigint").groupBy("ngram").agg(F.sum("n").alias("n")).collect():  # at most SIZE + 1 rows
        out[ngram] = n
    return out[:SIZE], int(out[SIZE])


def train(rows: DataFrame, sample_rows: int = 6000, least_rows: int = 300, most_languages: int = 1000) -> LanguageModel:
    """Learn from a table (id, text, lang) without nulls; the weights from about ``sample_rows`` rows. More languages than ``most_languages`` are refused."""
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    per_language = {r["lang"]: r["n"] for r in counts}
    languages = sorted(per_language)
    if not languages:
        return LanguageModel([], np.zeros(SIZE), np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    frequency, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    share = {x: max(sample_rows / len(languages), least_rows) / n for x, n in per_language.items()}
    wanted = F.element_at(F.create_map(*[F.lit(y) for x in share.items() for y in x]), F.col("lang"))
    draw = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, langs = (batch.column(i).to_pylist() for i in range(3))
            out = [(i, x, *ngram_counts(t)) for i, t, x in zip(ids, texts, langs, strict=True) if has_letter(t)]
            types = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["id", "lang", "found", "counts"])

    sample = rows.filter(draw < wanted).select("id", "text", "lang").mapInArrow(features, "id bigint, lang string, found array<bigint>, counts array<bigint>")
    model = LanguageModel(languages, idf, np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    learned, held = [], []
    drawn = sorted(sample.toArrow().to_pylist(), key=lambda r: (r["id"], r["lang"], len(r["found"])))
    for k, r in enumerate(drawn):
        found = np.array(r["found"], np.intp)
        x = model.features(found, np.array(r["counts"]))
        (held if k % 5 == 4 else learned).append((found, x, languages.index(r["lang"])))
    weights, bias = ftrl(learned, len(languages))
    logits = np.array([x @ weights[found] + bias for found, x, _ in held])
    return LanguageModel(languages, idf, weights, bias, temperature(logits, np.array([y for _, _, y in held], int)))


def predict(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """A table (id, text) with lang_pred and score instead of the text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["id", "lang_pred", "score"])

    return rows.select("id", "text").mapInArrow(apply, "id bigint, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the identifiers, for testing; rows without identifier count as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(True))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 6000) -> DataFrame:
    """id, lang_pred and score of every document, learned from those that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(rows.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull()), sample_rows)
    return predict(rows, model)
