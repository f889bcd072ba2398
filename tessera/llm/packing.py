"""Best-fit packing planned over a histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. Only the counts by length (at most ``capacity`` numbers) go
to the driver, which runs best-fit decreasing over them and gets ranges of slots; every piece then takes its slot by its
rank among the pieces of its length. Null and empty texts are one piece with the end token alone; rows given twice are
packed twice; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def joins_no_words(spec: dict) -> bool:
    """Whether a tokenizer file treats the words between white space apart: known normalisers, and a split that keeps no white space."""
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    split = spec.get("pre_tokenizer") or {}
    split = split["pretokenizers"][0] if split.get("type") == "Sequence" and split["pretokenizers"] else split
    kept = split.get("pattern", {}).get("Regex", "")
    return all(x["type"] in ("NFC", "Lowercase") or x == blank for x in steps) and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and kept.endswith("[^\\s\\p{L}\\p{N}]+")


class WordEncoder:
    """Token ids of texts. Where the tokenizer never joins words over white space, the ids of words are remembered, up to ``limit`` words and ``most_bytes``."""

    def __init__(self, path: str, limit: int = 1_500_000, most_bytes: int = 128 << 20):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_word = joins_no_words(json.load(f))
        self.tokenizer, self.limit, self.most_bytes, self.known, self.size = Tokenizer.from_file(path), limit, most_bytes, {}, 0
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark = next(((i, t.content) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Many words go to the library as one text, parted by a special token, which parts them in every way."""
        if self.mark is None or any("<|" in w or self.mark[1] in w for w in words):
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out: list[bytes] = []
        for at in range(0, len(words), 1000):
            found = np.array(self.tokenizer.encode_batch_fast([self.mark[1].join(words[at : at + 1000])], add_special_tokens=False)[0].ids, np.uint32)
            marks, data = np.flatnonzero(found == self.mark[0]) * 4, found.tobytes()
            out += [data[lo:hi] for lo, hi in zip([0, *(marks + 4).tolist()], [*marks.tolist(), len(data)], strict=True)]
        return out

    def words(self, text: str) -> list[str]:
        if text.isascii() and "<|" not in text:  # special tokens are matched before the tokenizer's own lower-casing
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if not self.by_word:
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self.words(x) for x in texts]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > self.limit or self.size > self.most_bytes:
            self.known.clear()
            self.size = 0
            new = list(set().union(*split))
        ids = self.ids(new)
        self.known.update(zip(new, ids, strict=True))
        self.size += 4 * sum(map(len, new)) + sum(map(len, ids))
        return [b"".join(map(self.known.__getitem__, x)) for x in split]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token ids of every document, the end token appended, cut into pieces: doc_id, piece, start, length, ids (32-bit little-endian)."""
    end, width = array("I", [end_id]).tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                out: list[list] = [[], [], [], [], []]
                ids, texts = (part.column(i).to_pylist() for i in (0, 1))
                for doc, data in zip(ids, encoder.encode([x or "" for x in texts]), strict=True):
                    data += end
                    for k in range(0, len(data), width):
                        piece = data[k : k + width]
                        for column, value in zip(out, (doc, k // width, k // 4, len(piece) // 4, piece), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


class Slots(NamedTuple):
    """Pieces of ``length`` with ranks from ``first`` to before ``end`` go, ``per_sequence`` each, to the sequences from ``sequence_id``, at ``offset`` on."""

    length: int
    first: int
    end: int
    sequence_id: int
    per_sequence: int
    offset: int


def plan(counts: Mapping[int, int], capacity: int) -> list[Slots]:
    """Best-fit decreasing over counts by length; equal sequences are handled together, so the work does not grow with the counts."""
    out: list[Slots] = []
    spaces: list[int] = []  # room left, ascending, of the open sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, number of sequences)
    made = 0

    def put_back(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                open_[room] = []
                insort(spaces, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                room = spaces[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    spaces.pop(at)
            else:
                room, first = capacity, made
                n = -(-left // (capacity // length))
                made += n
            each = min(room // length, left)
            full = min(n, left // each)
            out.append(Slots(length, rank, rank + full * each, first, each, capacity - room))
            put_back(room - each * length, first, full)
            put_back(room, first + full, n - full)
            rank += full * each
            left -= full * each
    return out


def pack(pieces: DataFrame, capacity: int = 2048, order: Iterable[str] = ("doc_id", "piece", "start"), rows_per_group: int = 100_000) -> DataFrame:
    """``pieces`` (any table with a column length from 1 to ``capacity``) with sequence_id and offset. It is read more than once: pass a stored table.

    Columns of these two names are replaced; all others stay, whatever they are called, but for names that begin with ``__pack``.
    """
    spark = pieces.sparkSession
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots = plan(by_length, capacity)
    table = spark.createDataFrame(slots or [Slots(0, 0, 0, 0, 1, 0)], ", ".join(f"__pack_{c} bigint" for c in ("slot_length", "first", "end", "first_sequence", "per_sequence", "first_offset")))
    # One length can hold most pieces: ranks are counted in groups of about rows_per_group rows and shifted by the groups before.
    groups = max(64, sum(by_length.values()) // rows_per_group)
    keyed = pieces.withColumn("__pack_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = (
        keyed.groupBy("length", "__pack_group")
        .agg(F.count(F.lit(1)).alias("__pack_n"))
        .withColumn("__pack_before", F.sum("__pack_n").over(Window.partitionBy("length").orderBy("__pack_group")) - F.col("__pack_n"))
        .drop("__pack_n")
    )
    place = Window.partitionBy("length", "__pack_group").orderBy(*order)
    ranked = keyed.join(before, ["length", "__pack_group"]).withColumn("__pack_rank", F.col("__pack_before") + F.row_number().over(place) - 1)
    if len(slots) <= 100_000:  # at most a few for each pair of a length and a room left, however many documents there are
        table = F.broadcast(table)
    hit = (F.col("length") == F.col("__pack_slot_length")) & (F.col("__pack_rank") >= F.col("__pack_first")) & (F.col("__pack_rank") < F.col("__pack_end"))
    within = F.col("__pack_rank") - F.col("__pack_first")
    return (
        ranked.join(table, hit)
        .withColumn("sequence_id", F.col("__pack_first_sequence") + F.floor(within / F.col("__pack_per_sequence")))
        .withColumn("offset", F.col("__pack_first_offset") + F.pmod(within, F.col("__pack_per_sequence")) * F.col("length"))
        .select(*(c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")), "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack; the ids stay with their pieces."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
