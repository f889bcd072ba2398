"""The parser against all edits of short sequences, blocks against whole sequences, large conversations against small, and the query against its SQL."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import earley
from tessera.llm.conversation_repair import damaged, repaired_turns, rows_of, verdicts
from tessera.llm.queries import oracle_sql, queries

from ..parity import assert_same, connection

SYMBOLS = st.text("suaoSUAOx", max_size=40)


def all_edits(symbols):
    """The least (cost, audit) of all edits, with up to two rows inserted anywhere."""
    best = None

    def go(i, roles, cost, audit, put):
        nonlocal best
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = cost, audit
        if put < 2:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", put + 1)
        if i < len(symbols):
            c = symbols[i]
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if c != "x":
                go(i + 1, roles + c.lower(), cost + c.isupper(), audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + c.isupper(), audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


@settings(max_examples=60, deadline=None)
@given(st.text("suaoSUAOx", max_size=4))
def test_equals_all_edits(symbols):
    assert earley.repair(symbols) == all_edits(symbols)


@settings(max_examples=100, deadline=None)
@given(SYMBOLS, st.integers(1, 9))
def test_blocks_compose(symbols, block):
    cost, audit = earley.repair(symbols, block)
    whole = earley.parse(symbols)
    assert (cost, audit) == min(whole[q] for q in earley.FINAL if q in whole)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "other", "x": "user"}
    rows = [(names[c.lower()], str(k)) for k, c in enumerate(symbols)]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in earley.applied(audit, rows)))


def test_a_chart_column_is_bounded():
    assert earley.repair("uaU" * 3000)[0] > 0  # cost and time in proportion to the rows


def reference(rows, damage):
    """Verdicts by conversation, in plain Python, with ``earley.parse`` on whole sequences."""
    out, by_conv = {}, {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20 if damage else 9
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        kept += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, n = set(), "", [0, 0, 0]
        for _, role, text in kept:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
            seen.add((role, text))
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if fault is not None:
                n[fault] += 1
            symbols += "x" if fault in (0, 1) else c.upper() if fault == 2 else c
        roles = [r[1][:1] for r in kept]
        turns = {r[0] for r in kept} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        chart = earley.parse(symbols)
        cost, audit = min(chart[q] for q in earley.FINAL if q in chart)
        repaired = earley.applied(audit, [(r, t) for _, r, t in kept])
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def conversations(seed, n=400):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = draw.choice([None, 1, 1, 1, *range(2, 12)])
        turn = draw.choice([None, *range(60)])
        role = draw.choice(["user", "assistant", "user", "assistant", "system", None, "", "User", "tool", "ua"])
        text = draw.choice(["Yes.", "no", "", None, " \t", f"It is {draw.randrange(30)}!", f"cut {draw.randrange(30)}\n", "ÿ?"])
        rows.append((conv, turn, role, text))
    return [*rows, *rows[:20], *[(3, 4, "user", "again and again.")] * 700]


def assert_verdicts(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, rows int, conv string").repartition(3)
    for damage in (False, True):
        frame = damaged(rows_of(df)) if damage else rows_of(df)
        got = {r["conv_id"]: tuple(r)[1:] for r in verdicts(frame, **how).collect()}
        assert got == reference(rows, damage)


@pytest.mark.parametrize("how", [{}, {"most_rows": 30}, {"most_rows": 0}, {"most_bytes": 500}])
def test_verdicts(spark, how):
    assert_verdicts(spark, conversations(1), **how)


def test_a_conversation_without_rows_left(spark):
    gone = next(t for t in range(10_000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    for how in ({}, {"most_rows": 0}):
        assert_verdicts(spark, [(5, gone, "user", "x")], **how)
        got = verdicts(damaged(rows_of(spark.createDataFrame([(5, gone, "user", "x")], "conv_id int, turn int, role string, text string"))), **how).collect()
        assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_no_rows_and_long_texts(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert verdicts(rows_of(spark.createDataFrame([], schema))).count() == 0 == repaired_turns(rows_of(spark.createDataFrame([], schema))).count()
    assert_verdicts(spark, [(1, t, "ua"[t % 2] + "x", "é" * 700_000 + ".") for t in range(4)], most_bytes=1 << 20)


@pytest.mark.parametrize("how", [{}, {"most_rows": 0}])
def test_repaired_turns_are_what_the_digest_is_of(spark, how):
    df = spark.createDataFrame(conversations(2), "conv_id bigint, turn bigint, role string, text string")
    frame = rows_of(df)
    place = F.struct("part", "number", "place", F.concat_ws(":", "role", "text").alias("line"))
    lines = repaired_turns(frame, **how).groupBy("conv_id").agg(F.sort_array(F.collect_list(place)).alias("lines")).collect()
    have = {r["conv_id"]: hashlib.sha256("\n".join(x["line"] for x in r["lines"]).encode()).hexdigest() for r in lines}
    want = {r["conv_id"]: r["digest"] for r in verdicts(frame, **how).collect()}
    assert have and all(want[c] == d for c, d in have.items()) and all(d == hashlib.sha256(b"").hexdigest() for c, d in want.items() if c not in have)


def test_op13_equals_its_sql(spark, sf):
    assert_same(spark, connection(sf), queries()["op13_conversation_repair"], oracle_sql()["op13_conversation_repair"], sf)


def test_the_sql_equals_the_reference_on_odd_rows():
    import duckdb
    import pyarrow as pa

    rows = conversations(3, 150)
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])}))
    assert {r[0]: r[1:] for r in con.sql(oracle_sql()["op13_conversation_repair"]).fetchall()} == reference(rows, True)
