"""Benchmark decontamination by SimHash of windows along the items.

Windows begin at anchors, words chosen by content (the least hash among some neighbours), so a copied passage is cut alike
in a document and in a benchmark item, wherever it stands. Windows are fingerprinted: 64 bits, each the sign of a weighted
vote of the window's words. The fingerprints are cut into ``radius + 1`` blocks: two within ``radius`` of each other agree
in at least one block, so joining on blocks finds all of them.

A passage as similar as asked shares with the item at least ``least_run`` words in a row, as each interior edit costs four
shingles on both sides at least. So every item gives short windows all along it, of a size that such a run holds whole:
``SHORT`` words from anchors if the run is long enough to hold an anchor and the window, else windows at every word of item
and document. Besides, items give windows of the largest size of a ladder that fits them. Only passages that repeat words
of the item next to themselves (so that an edit costs the item nothing) can have shorter runs and be missed.

Each candidate pair is confirmed by the weighted similarity of word shingles (each counted as often as it occurs, the sum
of the lesser counts over the sum of the greater) of the most similar of all passages that could hold the window.

The benchmark is a small table next to the corpus: its items go to every worker, which indexes them once, if they are at most
``broadcast_items`` with at most ``broadcast_bytes`` of text; beyond, windows are joined by a shuffle on the blocks. Both ways find the same.

What is found depends on the texts alone, so texts and items are known by their SHA-256 where rows must be joined, never by
their identifiers. Null or empty texts and items match nothing; items of fewer words than a shingle are compared as one window of their own
length. Rows given twice are both found. Rows without identifier are found under a null identifier.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, written
from .words import ALNUM, U, mixed, shingles, text_words

NEIGHBOURS = 6
LADDER = (4, 6, 9, 13, 19, 28, 42, 63, 94, 141, 211, 316, 474, 711, 1066, 1599)
#: Words of the windows along an item; of its shorter runs, those of the largest of these that fits.
SHORT, SHORTER = 9, (1, 2, 3, 4, 5, 6, 9)
SHINGLE = 5
#: Votes are counted in 16 columns of four counts.
COLUMNS, LANES = 16, U(0x0001000100010001)


def anchors(words: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Positions that have the least hash of some ``NEIGHBOURS`` words in a row; at least one of each such row.

    ``lengths``: of the texts whose words follow each other. Where two texts meet there can be more anchors, never fewer.
    All words of a text with fewer words than neighbours are anchors.
    """
    n = len(words)
    if n < NEIGHBOURS:
        return np.arange(n)
    rows = np.lib.stride_tricks.sliding_window_view(mixed(words), NEIGHBOURS)
    marked = np.zeros(n, bool)
    marked[np.arange(n - NEIGHBOURS + 1) + rows.argmin(1)] = True
    if lengths is not None:
        marked |= np.repeat(lengths < NEIGHBOURS, lengths)
    return np.flatnonzero(marked)


def votes(words: np.ndarray) -> np.ndarray:
    """How many of the words up to each position vote for each of 64 bits: 16 rows of numbers with four counts of 16 bits each.

    Counts run over from one to the next in long texts, but differences of two positions are right for windows of up to 32767 words.
    """
    hashes = mixed(words ^ U(0x5851F42D4C957F2D))
    out = np.zeros((COLUMNS, len(words) + 1), U)
    for c in range(COLUMNS):
        np.cumsum((hashes >> U(c)) & LANES, out=out[c, 1:])
    return out


def fingerprints(sums: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each window of ``size`` words: whether more than half of its words vote for the bit."""
    every = 2 * len(first) > sums.shape[1] - size > 0  # then those of all positions come without gathering
    out, more = np.zeros(sums.shape[1] - size if every else len(first), U), LANES * U(0x8000 - (size // 2 + 1))
    for c, row in enumerate(sums):
        counts = row[size:] - row[:-size] if every else row[first + size] - row[first]
        out |= (((counts + more) >> U(15)) & LANES) << U(c)
    return out[first] if every else out


def least_run(n: int, similarity: float) -> int:
    """Words in a row that an item of n words has in common with any passage of at least this similarity.

    With ``breaks`` between the runs, the item lacks 4 shingles for each and the passage has 4 others for each.
    """
    total = n - SHINGLE + 1
    if total < 1:
        return n
    run = total
    for breaks in range(total // 4 + 1):
        shared = max(1, math.ceil(similarity * (total + 4 * breaks) - 1e-9))
        if shared > total - 4 * breaks:
            break
        run = min(run, -(-shared // (breaks + 1)))
    return run + SHINGLE - 1


def item_kinds(n: int, similarity: float) -> set[tuple[int, bool]]:
    """(size, whether at every word instead of at anchors) of the windows of an item of n words."""
    run = least_run(n, similarity)
    anchored = run >= SHORT + NEIGHBOURS - 1
    out = {(SHORT, False) if anchored else (max(s for s in SHORTER if s <= run), True)}
    return out | {(s, False) for s in [s for s in LADDER if SHORT <= s <= n - NEIGHBOURS + 1][-1:]}


def starts(n: int, at: np.ndarray, everywhere: bool) -> np.ndarray:
    return np.arange(n) if everywhere else at


def blocks(prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and value of each of ``radius + 1`` blocks of the fingerprints."""
    for k in range(radius + 1):
        lo, hi = 64 * k // (radius + 1), 64 * (k + 1) // (radius + 1)
        yield k, (prints >> U(lo)) & U((1 << (hi - lo)) - 1)


def item_windows(text: str | None, similarity: float) -> Iterator[tuple[int, bool, int, int]]:
    """(size, whether at every word, fingerprint, words before the window) of an item."""
    words = text_words(text, ALNUM)
    n = len(words)
    if n:
        at, sums = anchors(words), votes(words)
        for size, everywhere in sorted(item_kinds(n, similarity)):
            first = starts(n, at, everywhere)
            first = first[first + size <= n]
            for p, before in zip(fingerprints(sums, first, size).tolist(), first.tolist(), strict=True):
                yield size, everywhere, p, before


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two lists of shingles: the sum of the lesser counts over the sum of the greater."""
    names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(names)), np.bincount(where[len(a) :], minlength=len(names))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Item:
    """An item's words and its distinct shingles with their counts."""

    def __init__(self, text: str | None):
        self.words = text_words(text, ALNUM)
        self.shingles = shingles(self.words)
        self.names, self.counts = np.unique(self.shingles, return_counts=True)


def best_passage(words: np.ndarray, own: np.ndarray, item: Item, begins: list[int], similarity: float) -> tuple[float, int, int]:
    """Similarity, first word and number of words of the most similar passage (of equals, the first) around ``begins``.

    ``own``: the shingles of ``words``. Similarity is 0 where no passage is as similar as asked. A most similar passage begins
    and ends with shingles of the item, as leaving out others at its ends makes it more similar.
    """
    n, total = len(item.words), len(item.shingles)
    for start in sorted(begins):
        if 0 <= start <= len(words) - n and np.array_equal(words[start : start + n], item.words):
            return 1.0, start, n
    if n < SHINGLE or len(words) < SHINGLE:
        return 0.0, 0, 0
    most = max(total, int(total / similarity + 1e-9))  # shingles of a passage
    regions: list[list[int]] = []
    for start in sorted(begins):
        lo, hi = max(0, start - most), min(len(own), start + n + most)
        if regions and lo <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], hi)
        else:
            regions.append([lo, hi])
    best = (0.0, 0, 0)
    for lo, hi in regions:
        name = np.minimum(np.searchsorted(item.names, own[lo:hi]), len(item.names) - 1)
        at = np.flatnonzero(item.names[name] == own[lo:hi])
        name = name[at]
        m = len(at)
        if np.minimum(np.bincount(name, minlength=len(item.names)), item.counts).sum() < similarity * total:
            continue
        # an occurrence counts in passages that begin after the one as many occurrences before as the item has
        order = np.argsort(name, kind="stable")
        j = np.arange(m) - item.counts[name[order]]
        spent = np.full(m, -1)
        spent[order] = np.where((j >= 0) & (name[order][np.maximum(j, 0)] == name[order]), order[np.maximum(j, 0)], -1)
        end = np.searchsorted(at, at + most, "left")
        begin = np.flatnonzero(end - np.arange(m) >= similarity * total)
        if not len(begin):
            continue
        width = int((end[begin] - begin).max())
        step = max(1, (1 << 20) // width)
        for k in range(0, len(begin), step):
            a = begin[k : k + step, None]
            b = a + np.arange(width)
            inside = b < end[a]
            b = np.minimum(b, m - 1)
            shared = np.cumsum((spent[b] < a) & inside, axis=1)
            length = at[b] - at[a] + 1
            found = np.where(inside, shared / (total + length - shared), 0.0)
            i = int(found.argmax())
            if found.flat[i] > best[0]:
                best = (float(found.flat[i]), lo + int(at[a[i // width, 0]]), int(length.flat[i]) + SHINGLE - 1)
    return best if best[0] >= similarity else (0.0, 0, 0)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, radius: int = 3,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_items: int = 20_000, broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """(id, item, similarity, first_word, n_words): for each document and item found in it, the most similar passage."""
    items = _few_items(benchmark, item_col, item_text_col, broadcast_items, broadcast_bytes)
    if items is None:
        return _by_shuffle(docs, benchmark, similarity, radius, id_col, text_col, item_col, item_text_col)
    return _matches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), items, similarity, radius)


def _few_items(benchmark: DataFrame, item_col: str, item_text_col: str, most: int, most_bytes: int) -> list[tuple[int, str]] | None:
    """The items with a text; None if there are more than ``most`` or their texts have more than ``most_bytes`` bytes."""
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return [(r[0], r[1]) for r in rows.collect()] if n <= most and size <= most_bytes else None


#: The index that this worker has built last, by the key of its search.
_INDEXES: dict[str, Index] = {}


def _index(key: str, items: list[tuple[int, str]], radius: int, similarity: float) -> Index:
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items, radius, similarity)
    return _INDEXES[key]


class Index:
    """Fingerprints of item windows by (size, whether at every word) and block."""

    def __init__(self, items: list[tuple[int, str]], radius: int, similarity: float = 0.75):
        self.radius, self.items = radius, [(i, Item(t)) for i, t in items]
        by_kind: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for size, everywhere, p, before in item_windows(text, similarity):
                by_kind.setdefault((size, everywhere), []).append((p, k, before))
        self.tables = {}
        for kind, found in by_kind.items():
            prints = np.array([x[0] for x in found], U)
            tables = []
            for _, values in blocks(prints, radius):
                order = np.argsort(values, kind="stable")
                there = np.zeros(1 << 16, bool)  # which values occur, by their last 16 bits
                there[(values & U(0xFFFF)).astype(np.intp)] = True
                tables.append((values[order], order, there))
            self.tables[kind] = (prints, np.array([x[1] for x in found]), np.array([x[2] for x in found]), tables)

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int, int]]:
        """(number of the text, number of the item, word at which it would begin) for the words of some texts."""
        out: set[tuple[int, int, int]] = set()
        lengths = np.array([len(x) for x in texts], np.int64)
        if not lengths.sum() or not self.tables:
            return out
        words = np.concatenate(texts)
        at, sums = anchors(words, lengths), votes(words)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        of = np.repeat(np.arange(len(texts)), lengths)
        for (size, everywhere), (prints, item, before, tables) in self.tables.items():
            first = starts(len(words), at, everywhere)
            first = first[first + size <= ends[of[first]]]
            if not len(first):
                continue
            own = fingerprints(sums, first, size)
            for (_, values), (known, order, there) in zip(blocks(own, self.radius), tables, strict=True):
                hit = np.flatnonzero(there[(values & U(0xFFFF)).astype(np.intp)])
                lo, hi = np.searchsorted(known, values[hit], "left"), np.searchsorted(known, values[hit], "right")
                n = hi - lo
                if not n.any():
                    continue
                w = np.repeat(hit, n)
                k = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                near = np.bitwise_count(own[w] ^ prints[k]) <= self.radius
                text = of[first[w[near]]]
                out.update(zip(text.tolist(), item[k[near]].tolist(), (first[w[near]] - begins[text] - before[k[near]]).tolist(), strict=True))
        return out

    def matches(self, texts: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int, tuple[float, int, int]]]:
        """Number of the text, number of the item and the most similar passage, for each pair that is as similar as asked."""
        begins: dict[int, dict[int, list[int]]] = {}
        for text, k, start in self.candidates(texts):
            begins.setdefault(text, {}).setdefault(k, []).append(start)
        for text, by_item in sorted(begins.items()):
            own = shingles(texts[text])
            for k, at in sorted(by_item.items()):
                found = best_passage(texts[text], own, self.items[k][1], at, similarity)
                if found[0]:
                    yield text, k, found


FOUND = "id bigint, item bigint, similarity double, first_word bigint, n_words bigint"


def _matches(rows: DataFrame, items: list[tuple[int, str]], similarity: float, radius: int) -> DataFrame:
    key = uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, items, radius, similarity)
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for lo in range(0, batch.num_rows, 100):
                words = [text_words(x, ALNUM) for x in batch.column(1).slice(lo, 100).to_pylist()]
                out += [(ids[lo + text], index.items[k][0], *found) for text, k, found in index.matches(words, similarity)]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["id", "item", "similarity", "first_word", "n_words"])

    return rows.mapInArrow(search, FOUND)


def _by_shuffle(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The same search for a large benchmark: what is found in each text, for all rows of the text and of the item."""
    found = _found_keys(docs, benchmark, similarity, radius, id_col, text_col, item_col, item_text_col)
    texts, asked = _keyed(docs, id_col, text_col), _keyed(benchmark, item_col, item_text_col)
    rows = found.join(texts.select("key", "id"), "key").join(asked.select(F.col("key").alias("item_key"), F.col("id").alias("item")), "item_key")
    return rows.select("id", "item", "similarity", "first_word", "n_words")


def _found_keys(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(key, item_key, similarity, first_word, n_words): windows of both sides are joined on (kind, block number, block)."""

    def windows(of_items: bool, kinds: list[tuple[int, bool]]):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if of_items:
                        found = list(item_windows(text, similarity))
                    else:
                        words = text_words(text, ALNUM)
                        at, sums = anchors(words), votes(words)
                        found = []
                        for size, everywhere in kinds:
                            first = starts(len(words), at, everywhere)
                            first = first[first + size <= len(words)]
                            found += [(size, everywhere, p, f) for p, f in zip(fingerprints(sums, first, size).tolist(), first.tolist(), strict=True)]
                    for size, everywhere, p, where in found:
                        out += [(key, size, everywhere, k, int(v[0]), p - (1 << 63), where) for k, v in blocks(np.array([p], U), radius)]
                types = (pa.binary(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["key", "size", "everywhere", "block", "value", "print", "at"])

        return make

    schema = "key binary, size int, everywhere boolean, block int, value bigint, print bigint, at bigint"
    texts, asked = (_keyed(*x) for x in ((docs, id_col, text_col), (benchmark, item_col, item_text_col)))
    asked_texts = asked.select("key", "text").dropDuplicates(["key"])
    known = written(asked_texts.mapInArrow(windows(True, []), schema), "item-windows")
    kinds = [(r["size"], r["everywhere"]) for r in known.select("size", "everywhere").distinct().collect()]  # few: sizes of the ladder and below
    own = texts.select("key", "text").mapInArrow(windows(False, kinds), schema)
    a, b = own.alias("a"), known.alias("b")
    near = (F.col("a.size") == F.col("b.size")) & (F.col("a.everywhere") == F.col("b.everywhere")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value"))
    pairs = a.join(b, near).filter(F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))) <= radius)
    pairs = pairs.select(F.col("a.key").alias("key"), F.col("b.key").alias("item_key"), (F.col("a.at") - F.col("b.at")).alias("start"))
    pairs = written(pairs.groupBy("key", "item_key").agg(F.collect_set("start").alias("begins")), "candidates")
    of_docs = texts.select("key", "text").join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    full = pairs.join(asked_texts.select(F.col("key").alias("item_key"), F.col("text").alias("item_text")), "item_key").join(of_docs, "key").select("key", "text", "item_key", "item_text", "begins")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, item, item_text, begins in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                words = text_words(text, ALNUM)
                found = best_passage(words, shingles(words), Item(item_text), begins, similarity)
                if found[0]:
                    out.append((doc, item, *found))
            types = (pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["key", "item_key", "similarity", "first_word", "n_words"])

    return full.mapInArrow(confirm, "key binary, item_key binary, similarity double, first_word bigint, n_words bigint")


def _key(text_col: str):
    return F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256))


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text) of the rows with a text."""
    return rows.filter(F.col(text_col).isNotNull()).select(_key(text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, radius: int = 3,
    item_col: str = "item_id", item_text_col: str = "text", broadcast_items: int = 20_000, broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""
    items = _few_items(benchmark, item_col, item_text_col, broadcast_items, broadcast_bytes)
    if items is None:
        keys = _found_keys(docs, benchmark, similarity, radius, id_col, text_col, item_col, item_text_col).select("key").distinct()
        name = fresh(docs, "__key")
        return docs.join(written(keys.select(F.col("key").alias(name)), "contaminated"), _key(text_col) == F.col(name), "left_anti")

    search = uuid4().hex

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _index(search, items, radius, similarity)
        for batch in batches:
            out = np.ones(len(batch), bool)
            for lo in range(0, len(batch), 100):
                words = [text_words(x, ALNUM) for x in batch.slice(lo, 100).to_pylist()]
                out[[lo + text for text, *_ in index.matches(words, similarity)]] = False
            yield pa.array(out)

    return docs.filter(F.arrow_udf(clean, "boolean")(F.col(text_col).cast("string")))
