"""Token counts by finite-state transducers.

Two deterministic machines are compiled from a byte-level BPE tokenizer file. The splitter reads code points and marks
where words begin; a text is read in many chunks at once, each for every start state, and the chunks' state maps compose
through a parallel prefix scan. The word machine reads the bytes of all words in step; each of its transitions carries
the number of tokens that the byte adds (a later byte may take tokens back). Its states are made when first reached: the
tail of a word that may still become part of a token, with the last token and the count before each of its bytes.
That this reproduces the merges rests on two facts of BPE: a prefix of a tokenization is the tokenization of its bytes,
and a tokenization is right when each two neighbours are.

Null and empty texts have no tokens. Rows are counted one by one, so rows given twice count twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Input classes of the splitter: a text's end, letters (those of contractions apart), numbers, white space, marks.
END, LETTER, STMD, R_V, L, E, NUMBER, BLANK, SPACE, APOSTROPHE, MARK = range(11)
# Its states. BLANK1 and SPACES1: one white-space character so far; BLANKS and SPACESN: more. BLANK: the last is U+0020.
(START, WORD, DIGITS, MARKS, BLANK1, BLANKS, SPACES1, SPACESN, QUOTE, CONTRACTION, QUOTE_RV, QUOTE_L) = range(12)
STATES, HERE, BEFORE = 12, 1, 2  # a word begins at this character, at the one before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables, of states by classes."""
    step, out = np.zeros((STATES, 11), np.intp), np.zeros((STATES, 11), np.uint8)
    letters = (LETTER, STMD, R_V, L, E)
    fresh = {END: START, NUMBER: DIGITS, BLANK: BLANK1, SPACE: SPACES1, APOSTROPHE: QUOTE, MARK: MARKS} | dict.fromkeys(letters, WORD)
    for state in range(STATES):
        for c in range(11):
            begins, target = (0 if c == END else HERE), fresh[c]
            if state == WORD and c in letters or state == DIGITS and c == NUMBER:
                begins = 0
            elif state in (MARKS, QUOTE) and c in (APOSTROPHE, MARK):
                begins, target = 0, MARKS
            elif state == QUOTE and c in (STMD, R_V, L):
                begins, target = 0, {STMD: CONTRACTION, R_V: QUOTE_RV, L: QUOTE_L}[c]
            elif (state, c) in ((QUOTE_RV, E), (QUOTE_L, L)):
                begins, target = 0, CONTRACTION
            elif state in (QUOTE_RV, QUOTE_L):  # no contraction: the letter began a word
                begins = BEFORE | (0 if c in letters else begins)
            elif state in (BLANK1, BLANKS, SPACES1, SPACESN):
                if c in (BLANK, SPACE):
                    begins, target = 0, BLANKS if c == BLANK else SPACESN
                elif c != END:
                    if state in (BLANK1, BLANKS):  # the blank joins what follows
                        begins = BEFORE if state == BLANKS else 0
                        target = MARKS if c == APOSTROPHE else target
                    else:
                        begins = HERE | (BEFORE if state == SPACESN else 0)
            step[state, c], out[state, c] = target, begins
    return step, out


@cache
def _classes() -> np.ndarray:
    """The class of every code point, letters and numbers as the tokenizers library knows them; the last entry is a text's end."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    spaces = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    table = np.full(0x110001, MARK, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for pattern, kind in (("\\p{L}", LETTER), ("\\p{N}", NUMBER)):
        table[[ord(x) for x, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)]] = kind
    table[list(spaces)] = SPACE
    for chars, kind in (("stmd", STMD), ("rv", R_V), ("l", L), ("e", E), (" ", BLANK), ("'", APOSTROPHE)):
        table[[ord(x) for x in chars]] = kind
    table[0x110000] = END
    return table


class Splitter:
    def __init__(self, chunk: int = 256):
        self.chunk = chunk
        step, self.out = _splitter()
        self.step = (step * 11).ravel()  # states are held times the number of classes

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a word begins at each position."""
        n, m = len(kinds), self.chunk
        k = -(-n // m)
        grid = np.full(k * m, END, np.intp)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(k, m).T)
        maps = np.broadcast_to(np.arange(STATES) * 11, (k, STATES)).copy()
        for column in grid:  # each chunk from every state
            maps = self.step.take(maps + column[:, None])
        shift = 1
        while shift < k:  # prefix scan: maps[i] becomes the map of all chunks up to i
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift] // 11, 1)
            shift *= 2
        state = np.zeros(k, np.intp)
        state[1:] = maps[:-1, START]
        said = np.empty((m, k), np.uint8)
        out = self.out.ravel()
        for j, column in enumerate(grid):
            at = state + column
            said[j] = out.take(at)
            state = self.step.take(at)
        flat = np.ascontiguousarray(said.T).ravel()
        begins = (flat & HERE).astype(bool)
        begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return begins[:n]


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordMachine:
    """Counts the tokens of words; states and transitions are made on demand and dropped once there are too many."""

    def __init__(self, merges: list[tuple[bytes, bytes]], limit: int = 200_000):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.openings = {t[:i] for t in self.tokens for i in range(len(t))}
        self.limit, self.fit = limit, {}
        self.reset()

    def reset(self) -> None:
        self.columns, self.width = np.full(256, -1, np.intp), 128
        self.ids, self.states = {}, []
        self.next, self.adds = np.full((4096, self.width), -1, np.int32), np.zeros((4096, self.width), np.int8)
        self.state_of((b"", ((b"", 0),)))

    def state_of(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)])
        return self.ids[key]

    def tokenized(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: bytes, token: bytes) -> bool:
        """Whether the token may follow the left one, or begin a word."""
        key = (left, token)
        if key not in self.fit:
            if len(self.fit) > 1_000_000:
                self.fit.clear()
            self.fit[key] = self.tokenized(left + token) == ([left, token] if left else [token])
        return self.fit[key]

    def follow(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the number of tokens added."""
        tail, back = self.states[state]
        tail += bytes([byte])
        token, since = next((tail[-n:], back[n - 1][1]) for n in range(len(tail), 0, -1) if tail[-n:] in self.tokens and self.fits(back[n - 1][0], tail[-n:]))
        while tail not in self.openings:
            tail = tail[1:]
        added = 1 - since
        return self.state_of((tail, ((token, 0), *((t, n + added) for t, n in back[: len(tail)])))), added

    def learn(self, states: np.ndarray, data: np.ndarray) -> None:
        for key in np.unique(states.astype(np.int64) * 256 + data):
            s, b = divmod(int(key), 256)
            target, added = self.follow(s, b)
            self.next[s, self.columns[b]], self.adds[s, self.columns[b]] = target, added

    def counts(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of tokens of each word data[first : first + length]."""
        if len(self.states) > self.limit:
            self.reset()
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.columns[b] < 0:
                self.columns[b] = self.columns.max() + 1
                if self.columns[b] >= self.width:
                    self.next = np.hstack([self.next, np.full((len(self.next), 256 - self.width), -1, np.int32)])
                    self.adds = np.hstack([self.adds, np.zeros((len(self.adds), 256 - self.width), np.int8)])
                    self.width = 256
        order = np.argsort(-length, kind="stable")
        at = first[order]
        alive = len(length) - np.cumsum(np.bincount(length))  # words longer than j
        state, total = np.zeros(len(length), np.intp), np.zeros(len(length), np.int64)
        for j in range(int(length.max(initial=0))):
            n = int(alive[j])
            bytes_ = data[at[:n] + j]
            columns = self.columns[bytes_]
            target = self.next[state[:n], columns]
            unknown = target < 0
            if unknown.any():
                self.learn(state[:n][unknown], bytes_[unknown])
                target = self.next[state[:n], columns]
            total[:n] += self.adds[state[:n], columns]
            state[:n] = target
        out = np.empty(len(length), np.int64)
        out[order] = total
        return out


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for that the machines do not do."""
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    out = [] if spec.get("normalizer") is None else ["normalizer"]
    out += [f"pre_tokenizer.{k}" for k, v in plain.items() if splitter.get(k) != v]
    out += [] if model.get("type", "BPE") == "BPE" else ["model.type"]
    out += [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    return out + [f"added token {x['content']}" for x in spec["added_tokens"] if not x["special"] or x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]]


class TokenCounter:
    """Counts by the tokenizer file ``path`` (byte-level BPE with the splitting rule of contractions, letters, numbers, marks and white space); others are refused."""

    def __init__(self, path: str, batch: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if unsupported(spec):
            raise ValueError(f"unsupported tokenizer settings: {', '.join(unsupported(spec))}")
        to_byte = _byte_alphabet()
        plain = lambda s: bytes(to_byte[c] for c in s)
        merges = [tuple(map(plain, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words, self.splitter, self.batch = WordMachine(merges), Splitter(), batch

    def segments(self, text: str) -> list[str]:
        """The text around its special strings, each of which is one token."""
        parts = [text]
        for mark in self.special:
            if mark in text:
                parts = [y for x in parts for y in x.split(mark)]
        return parts

    def counts(self, texts: list[str]) -> list[int]:
        out, waiting, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            parts = self.segments(text)
            out[i] += len(parts) - 1
            for x in parts:
                if x:
                    waiting.append((i, x))
                    size += len(x)
            if size >= self.batch or i == len(texts) - 1:
                for k, n in self._counted(waiting):
                    out[k] += n
                waiting, size = [], 0
        return out

    def _counted(self, parts: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
        if not parts:
            return
        lengths = np.fromiter((len(x) for _, x in parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1  # where each text's end stands
        joined = "\x00".join(x for _, x in parts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.intp)
        kinds = _classes()[points]
        kinds[ends] = END
        begins = np.flatnonzero(self.splitter.starts(kinds))
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        sizes[ends] = 0
        place = np.cumsum(sizes) - sizes
        data = np.frombuffer("".join(x for _, x in parts).encode(), np.uint8)
        first = place[begins]
        length = np.diff(np.append(first, len(data)))
        counted = self.words.counts(data, first, length)
        text_of = np.searchsorted(ends, begins)
        for k, n in enumerate(np.bincount(text_of, counted, len(parts)).astype(np.int64).tolist()):
            yield parts[k][0], n


_counters: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = TokenCounter(tokenizer)
        counter = _counters[tokenizer]
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counter.counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
