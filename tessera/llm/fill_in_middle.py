"""Fill-in-middle transformation on ropes.

A text is a balanced tree whose leaves hold pieces of it and cache how many units and code points they have; a unit is a code
point or what a pattern matches. The tree is split at two unit ranks, and the three subtrees are joined in another order with
sentinels between them: nothing is copied but the leaves at the two cuts. The way back builds a tree of the output, finds the
sentinels and splits there.

Null texts count as empty, and empty texts stay as they are (form ``plain``), as do texts that contain a sentinel. The draws
depend on seed and identifier alone; rows without identifier draw as if it were empty, rows given twice draw alike. A text of any length is one row:
memory is that of its leaves. An empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, text_or_empty

UNITS, CHARS = 0, 1


class Leaf:
    """A piece of text. ``starts``: where its units begin, or None if each code point is one."""

    __slots__ = ("text", "starts", "size")
    height = 0

    def __init__(self, text: str, starts: list[int] | None = None):
        self.text, self.starts = text, starts
        self.size = (len(text) if starts is None else len(starts), len(text))

    def cut(self, at: int, measure: int) -> tuple[Leaf, Leaf]:
        """Both halves at 0 < ``at`` < size; a unit that a cut by code points goes through belongs to the left."""
        if self.starts is None:
            return Leaf(self.text[:at]), Leaf(self.text[at:])
        char = self.starts[at] if measure == UNITS else at
        return Leaf(self.text[:char], [s for s in self.starts if s < char]), Leaf(self.text[char:], [s - char for s in self.starts if s >= char])


class Node:
    __slots__ = ("left", "right", "size", "height")

    def __init__(self, left: Leaf | Node, right: Leaf | Node):
        self.left, self.right = left, right
        self.size = (left.size[0] + right.size[0], left.size[1] + right.size[1])
        self.height = 1 + max(left.height, right.height)


Rope = Leaf | Node | None


def _node(left: Leaf | Node, right: Leaf | Node) -> Node:
    """A node of two balanced trees whose heights differ by two at most, rotated where they do."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def joined(left: Rope, right: Rope) -> Rope:
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return _node(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return _node(joined(left, right.left), right.right)
    return Node(left, right)


def split(rope: Rope, at: int, measure: int = UNITS) -> tuple[Rope, Rope]:
    """What lies before the unit (or code point) of rank ``at``, and the rest."""
    if rope is None or at <= 0:
        return None, rope
    if at >= rope.size[measure]:
        return rope, None
    if isinstance(rope, Leaf):
        return rope.cut(at, measure)
    before = rope.left.size[measure]
    if at <= before:
        a, b = split(rope.left, at, measure)
        return a, joined(b, rope.right)
    a, b = split(rope.right, at - before, measure)
    return joined(rope.left, a), b


def built(text: str, unit: re.Pattern | None = None, leaf: int = 4096) -> Rope:
    """A balanced tree. With a pattern a unit runs from one match to the next (the first from the start of the text)."""
    if not text:
        return None
    if unit is None:
        leaves = [Leaf(text[i : i + leaf]) for i in range(0, len(text), leaf)]
    else:
        starts = [m.start() for m in unit.finditer(text) if m.start() < len(text)] or [0]
        starts[0] = 0
        leaves = []
        for i in range(0, len(starts), leaf):
            first, end = starts[i], starts[i + leaf] if i + leaf < len(starts) else len(text)
            leaves.append(Leaf(text[first:end], [s - first for s in starts[i : i + leaf]]))
    while len(leaves) > 1:
        leaves = [joined(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def leaves(rope: Rope) -> Iterator[Leaf]:
    waiting = [rope] if rope else []
    while waiting:
        x = waiting.pop()
        if isinstance(x, Leaf):
            yield x
        else:
            waiting += (x.right, x.left)


def flat(rope: Rope) -> str:
    return "".join(x.text for x in leaves(rope))


def found(rope: Rope, mark: str) -> int:
    """The code point at which ``mark`` first stands, across leaves too; -1 if nowhere."""
    at, tail = 0, ""
    for x in leaves(rope):
        hit = (tail + x.text).find(mark)
        if hit >= 0:
            return at - len(tail) + hit
        at += len(x.text)
        tail = (tail + x.text)[1 - len(mark) :] if len(mark) > 1 else ""
    return -1


@dataclass(frozen=True)
class Rearrangement:
    """How often, and into what. The forms: ``psm`` has the prefix first, ``spm`` the suffix."""

    seed: int = 1
    percent: int = 90
    suffix_first_percent: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    unit: str | None = None

    def marks(self, form: str) -> tuple[str, str, str]:
        return (self.suffix_mark, self.prefix_mark, self.middle_mark) if form == "spm" else (self.prefix_mark, self.suffix_mark, self.middle_mark)

    def apply(self, identifier: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """Number of units, form, code points of prefix and middle, output."""
        rope = built(text, re.compile(self.unit) if self.unit else None)
        n = rope.size[UNITS] if rope else 0
        drawn = sha256(f"{self.seed}:{'' if identifier is None else identifier}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
        if not n or h3 % 100 >= self.percent or any(found(rope, m) >= 0 for m in (self.prefix_mark, self.suffix_mark, self.middle_mark)):
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        head, suffix = split(rope, second)
        prefix, middle = split(head, first)
        form = "spm" if h4 % 100 < self.suffix_first_percent else "psm"
        parts = (suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle)
        out: Rope = None
        for mark, part in zip(self.marks(form), parts):
            out = joined(joined(out, Leaf(mark, None if self.unit is None else [0])), part)
        sizes = [x.size[CHARS] if x else 0 for x in (prefix, middle)]
        return n, form, *sizes, flat(out)

    def invert(self, form: str, output: str) -> str:
        """The text again; an output that lacks the sentinels of its form is refused."""
        if form == "plain":
            return output
        rest, parts = built(output), []
        for mark in self.marks(form):
            at = found(rest, mark)
            if at < 0:
                raise ValueError(f"no {mark} in an output of form {form}")
            before, rest = split(rest, at, CHARS)
            parts.append(before)
            rest = split(rest, len(mark), CHARS)[1]
        _, a, b = parts
        prefix, suffix = (b, a) if form == "spm" else (a, b)
        return flat(joined(joined(prefix, rest), suffix))


SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, how: Rearrangement = Rearrangement(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n (units), form, prefix_chars, middle_chars (null if plain), output."""

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                rows = [how.apply(i, t) for i, t in zip(ids, part.column(1).to_pylist())]
                columns = [ids, *(list(c) for c in zip(*rows))] if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(rearrange, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, how: Rearrangement = Rearrangement(), name: str = "restored") -> DataFrame:
    """What ``fill_in_middle`` gives, with the texts rebuilt from output and form alone."""
    schema = SCHEMA.append(pa.field(name, pa.string()))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [how.invert(f, o) for f, o in zip(part.column("form").to_pylist(), part.column("output").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name).cast(f.type) for f in SCHEMA), pa.array(texts, pa.string())], schema=schema)

    return rows.select(*SCHEMA.names).mapInArrow(rebuild, f"id long, n long, form string, prefix_chars long, middle_chars long, output string, {name} string")
