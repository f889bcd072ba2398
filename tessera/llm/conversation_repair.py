"""Repair of conversation structure by error-correcting Earley parsing (``earley``).

Rows of a conversation are taken by turn (nulls first; rows of one turn by role and text). A row must go if it is blank or if its role and text were seen
earlier; the cheapest edits (keep, change the role, delete, insert) make the initials of the roles a sentence of ``(s?(ua)+)?``.

Conversations of up to ``most_rows`` rows and ``most_bytes`` are one group of a task. Larger ones are sorted by ranges over all tasks, cut into blocks, each
parsed from every nonterminal that may come before it; the blocks' tables are composed in order, so no task holds the rows of
such a conversation, and its digest is made from the repaired blocks one by one. Both ways give the same rows.

Null roles and texts are one space, as are nulls in the key that damage is drawn by. Rows without conversation are one conversation, whose number is null.
A role that is empty has no initial: it is legal nowhere. Rows given twice are duplicates of each other. A conversation without rows left has zeros, an empty
audit and the digest of nothing. An empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .earley import MUST_GO, Path, applied, maps, repair
from .shared import joined_by_weight, new_path, slices, temporary, written, written_at

BLOCK, BLOCK_BYTES = 256, 4 << 20
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: What may follow each other as initials of roles.
LEGAL = {"su", "ua", "au"}
TURN = "struct<turn: bigint, role: string, text: string, times: bigint>"


def rows_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv (text; a space for null), turn, role, text, times (how often the row stands there): nulls as spaces."""
    conv, turn = F.col(conv_col).cast("long").cast("string"), F.col(turn_col).cast("long")
    space = F.lit(" ")
    return conversations.select(
        F.coalesce(conv, space).alias("conv"), turn.alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), F.lit(1).cast("long").alias("times")
    )


def damaged(rows: DataFrame, parts: int = 20) -> DataFrame:
    """Rows of ``rows_of`` after damage drawn by conversation and turn: 0 of ``parts`` drops a row (times 0), 1 empties its text, 2 takes the marks at which
    sentences end, 3 gives it twice, 4 makes it a user's."""
    draw = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % parts
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv",
        "turn",
        F.when(draw == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("times") * F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)).alias("times"),
    )


class Reading:
    """Symbols and counts of rows that come in order."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first: str | None = None
        self.last: str | None = None

    def take(self, role: str, text: str, times: int, seen: bool) -> None:
        """``times`` equal rows; ``seen``: there was one before them."""
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += times - 1  # no initial may follow itself
        self.last = initial
        ink = text.rstrip(WHITE)
        if not ink:
            self.blank += times
            self.symbols.append(MUST_GO * times)
            return
        new = not seen
        self.duplicate += times - new
        if new:
            cut = ink[-1] not in ".!?"
            self.truncated += cut
            symbol = initial if initial in ("s", "u", "a") else "o"
            self.symbols.append(symbol.upper() if cut else symbol)
        self.symbols.append(MUST_GO * (times - new))


def digest_of(turns: Iterable[tuple[str, str]]) -> str:
    return sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


VERDICT = pa.schema(
    [("conv", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("digest", pa.string())]
)
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _sql(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", TURNS: "array<struct<role: string, text: string>>", MAP: f"array<{MAP_SQL}>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _whole(keep_turns: bool):
    """Verdicts of conversations that are one row each: conv, rows in order."""
    schema = VERDICT.append(pa.field("turns", TURNS)) if keep_turns else VERDICT

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                out = [_judged(conv, rows, keep_turns) for conv, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                columns = zip(*out) if out else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return judge, schema


def _judged(conv: str, rows: list[dict], keep_turns: bool) -> tuple:
    reading, seen, flat = Reading(), set(), []
    for r in rows:
        key = (r["role"], r["text"])
        reading.take(*key, r["times"], key in seen)
        seen.add(key)
        flat += [key] * r["times"]
    turns = {r["turn"] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = repair("".join(reading.symbols))
    repaired = applied(audit, flat)
    verdict = (conv, gaps, reading.blank, reading.duplicate, reading.truncated, reading.illegal, cost, audit, digest_of(repaired))
    return (*verdict, [{"role": a, "text": b} for a, b in repaired]) if keep_turns else verdict


MAP = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
MAP_SQL = "struct<entry: int, exit: int, cost: bigint, audit: string>"
BLOCKS = pa.schema(
    [
        ("conv", pa.string()),
        ("part", pa.int64()),
        ("number", pa.int64()),
        *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")),
        ("first", pa.string()),
        ("last", pa.string()),
        ("map", MAP),
        ("turns", TURNS),
    ]
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (conv, role, text, times, seen) that come in order; ``part`` and ``number`` order the blocks of a conversation."""
    task = TaskContext.get().partitionId()
    number, conv, reading, turns, size = 0, None, Reading(), [], 0

    def block() -> pa.RecordBatch:
        table = [{"entry": p, "exit": q, "cost": c, "audit": a} for p, ends in maps("".join(reading.symbols)).items() for q, (c, a) in ends.items()]
        row = (conv, task, number, reading.blank, reading.duplicate, reading.truncated, reading.illegal, reading.first, reading.last, table, turns)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS)], schema=BLOCKS)

    for batch in batches:
        for part in slices(batch, 1000):
            for key, role, text, times, seen in zip(*(c.to_pylist() for c in part.columns)):
                if key != conv and turns:
                    yield block()
                    number, reading, turns, size = number + 1, Reading(), [], 0
                conv = key
                while times:
                    now = min(times, BLOCK - len(turns))
                    reading.take(role, text, now, seen)
                    turns += [{"role": role, "text": None if seen else text}] + [{"role": role, "text": None}] * (now - 1)  # copies go
                    times, seen, size = times - now, True, size + len(text)
                    if len(turns) == BLOCK or size > BLOCK_BYTES:
                        yield block()
                        number, reading, turns, size = number + 1, Reading(), [], 0
    if turns:
        yield block()


WAYS = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("illegal", pa.int64())])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before and after which nonterminal each block stands in the cheapest repair; the first row of a conversation has its cost, and its illegal neighbours
    across blocks. Of a conversation only four numbers a block are held."""
    conv, path, places, illegal, last = None, Path(), [], 0, None

    def done() -> Iterator[pa.RecordBatch]:
        cost, steps = path.end()
        for k in range(0, len(steps), 10_000):
            n = len(steps[k : k + 10_000])
            columns = ([conv] * n, *zip(*places[k : k + n]), *zip(*steps[k : k + n]), [0 if k else cost, *[0] * (n - 1)], [0 if k else illegal, *[0] * (n - 1)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WAYS)], schema=WAYS)

    for batch in batches:
        for part in slices(batch, 500):
            for key, task, number, first, end, table in zip(*(c.to_pylist() for c in part.columns)):
                if key != conv:
                    if places:
                        yield from done()
                    conv, path, places, illegal, last = key, Path(), [], 0, None
                block: dict[int, dict] = {}
                for x in table:
                    block.setdefault(x["entry"], {})[x["exit"]] = (x["cost"], x["audit"])
                path.add(block)
                places.append((task, number))
                illegal += last is not None and last + first not in LEGAL
                last = end
    if places:
        yield from done()


PIECES = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("audit", pa.string()), ("turns", TURNS)])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of each block."""
    for batch in batches:
        for part in slices(batch, 50):
            audits = part.column("audit").to_pylist()
            turns = [
                [{"role": a, "text": b} for a, b in applied(audit, [(r["role"], r["text"]) for r in rows], entry)]
                for audit, rows, entry in zip(audits, part.column("turns").to_pylist(), part.column("entry").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(n).cast(PIECES.field(n).type) for n in ("conv", "part", "number")), pa.array(audits, pa.string()), pa.array(turns, TURNS)], schema=PIECES)


SUMS = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("digest", pa.string())])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations whose pieces come in order, one piece at a time."""
    conv, audit, total, begun = None, [], sha256(), False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (conv, "".join(audit), total.hexdigest())], schema=SUMS)

    for batch in batches:
        for part in slices(batch, 50):
            for key, more, turns in zip(*(c.to_pylist() for c in part.columns)):
                if key != conv:
                    if conv is not None:
                        yield done()
                    conv, audit, total, begun = key, [], sha256(), False
                audit.append(more)
                for t in turns:
                    total.update(f"{chr(10) if begun else ''}{t['role']}:{t['text']}".encode())
                    begun = True
    if conv is not None:
        yield done()


def _large(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts and repaired pieces of conversations of any size."""
    one = written(rows.filter("times > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times")), "repair-rows")
    # the first of equal rows by turn, nulls first
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    keyed = one.withColumn("key", F.sha2(F.concat_ws(":", "conv", F.length("role").cast("string"), "role", "text"), 256)).withColumn("place", place)
    firsts = keyed.groupBy("key").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("places"))
    marked = joined_by_weight(keyed, firsts, "key", "places").select("conv", "turn", "role", "text", "times", (F.col("place") > F.col("first_place")).alias("seen"))
    ordered = marked.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", "text").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    blocks = written(ordered.select("conv", "role", "text", "times", "seen").mapInArrow(_blocks, _sql(BLOCKS)), "repair-blocks")
    maps_ = blocks.select("conv", "part", "number", "first", "last", "map").repartition("conv").sortWithinPartitions("conv", "part", "number")
    ways = written(maps_.mapInArrow(_ways, _sql(WAYS)), "repair-ways")
    chosen = blocks.join(ways.select("conv", "part", "number", "entry", "exit"), ["conv", "part", "number"])
    audit = F.filter("map", lambda x: (x["entry"] == F.col("entry")) & (x["exit"] == F.col("exit")))[0]["audit"].alias("audit")
    pieces = written(chosen.select("conv", "part", "number", "entry", audit, "turns").mapInArrow(_pieces, _sql(PIECES)), "repair-pieces")
    sums = pieces.repartition("conv").sortWithinPartitions("conv", "part", "number").select("conv", "audit", "turns").mapInArrow(_sums, _sql(SUMS))
    turns = one.groupBy("conv", "turn").agg(F.lit(1).alias("x")).groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("turns"))
    gaps = turns.select("conv", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"))
    counts = blocks.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    totals = ways.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("between"))
    # conversations without rows left are in none of these
    found = sizes.join(gaps, "conv", "left").join(counts, "conv", "left").join(totals, "conv", "left").join(sums, "conv", "left")
    zero = F.lit(0).cast("long")
    return (
        found.select(
            "conv",
            *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")),
            F.coalesce(F.col("illegal") + F.col("between"), zero).alias("illegal"),
            F.coalesce("cost", zero).alias("cost"),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("digest", F.lit(sha256().hexdigest())).alias("digest"),
        ),
        pieces,
    )


def _number(conv: str = "conv") -> Column:
    return F.when(F.col(conv) != " ", F.col(conv)).cast("long")


def _split(rows: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of small and of large conversations, and the latter's sizes."""
    n_bytes = (F.octet_length("text") + F.octet_length("role")) * F.greatest("times", F.lit(1))
    sizes = rows.groupBy("conv").agg(F.sum(F.greatest("times", F.lit(1))).alias("rows"), F.sum(n_bytes).alias("bytes"))
    over = written(sizes.filter((F.col("rows") > most_rows) | (F.col("bytes") > most_bytes)), "repair-sizes")
    if over.isEmpty():
        return rows, rows.limit(0), over
    sizes = written(sizes, "repair-all-sizes")
    sized = written(joined_by_weight(rows, sizes, "conv", "rows"), "repair-sized")
    large = (F.col("rows") > most_rows) | (F.col("bytes") > most_bytes)
    return sized.filter(~large).select(rows.columns), sized.filter(large).select(rows.columns), over


def _grouped(rows: DataFrame) -> DataFrame:
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"), F.col("times"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("times") > 0, turn))).alias("rows"))


def verdicts(rows: DataFrame, most_rows: int = 4096, most_bytes: int = 16 << 20) -> DataFrame:
    """Of rows as ``rows_of`` or ``damaged`` gives them, one row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (of the cheapest
    edits), digest (SHA-256 of the repaired ``role:text``, one a line)."""
    spark = rows.sparkSession
    with temporary(spark) as keep:
        small, large, over = _split(rows, most_rows, most_bytes)
        judge, schema = _whole(False)
        out = _grouped(small).mapInArrow(judge, _sql(schema))
        if not over.isEmpty():
            out = out.unionByName(_large(large, over.select("conv"))[0])
        return written_at(out.select(_number().alias("conv_id"), *VERDICT.names[1:]), keep(new_path(spark, "repair-verdicts")))


def repaired_turns(rows: DataFrame, most_rows: int = 4096, most_bytes: int = 16 << 20) -> DataFrame:
    """The repaired conversations: conv_id, part, number, place (which order a conversation's rows), role, text."""
    spark = rows.sparkSession
    with temporary(spark) as keep:
        small, large, over = _split(rows, most_rows, most_bytes)
        judge, schema = _whole(True)
        zero = F.lit(0).cast("long")
        pieces = _grouped(small).mapInArrow(judge, _sql(schema)).select("conv", zero.alias("part"), zero.alias("number"), "turns")
        if not over.isEmpty():
            pieces = pieces.unionByName(_large(large, over.select("conv"))[1].select("conv", "part", "number", "turns"))
        turns = pieces.select(_number().alias("conv_id"), "part", "number", F.posexplode("turns").alias("place", "t"))
        return written_at(turns.select("conv_id", "part", "number", "place", "t.role", "t.text"), keep(new_path(spark, "repaired-turns")))
