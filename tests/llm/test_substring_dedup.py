"""Repeated passages against brute force, on both ways through the buckets."""

import hashlib
import random
import re

import pytest

from tessera.llm.queries import oracle_sql, queries
from tessera.llm.substring_dedup import repeated_passages

from ..parity import assert_same, connection
from .cases import ODD, SCHEMA, empty, odd


def brute_force(rows, size):
    """(id, words, removed, kept) of each row, ascending; identifiers that are null come last and are no source."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - size + 1):
                key = tuple(w[p : p + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - size + 1):
            least = first.get(tuple(w[p : p + size]))
            if least is not None and (i is None or least < i):
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(df, **how):
    rows = repeated_passages(df, **how).collect()
    assert all((r["kept_text"] is not None) == (r["n_removed"] > 0) for r in rows)
    return rows


def assert_found(spark, rows, size, **how):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, digest int").repartition(3)
    want = brute_force(rows, size)
    got = found(df, size=size, **how)
    by_digest = {(i, hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")).encode()).hexdigest()): t for i, t in rows}
    have = []
    for r in got:
        text = " ".join(re.findall(r"[^\x20\x09-\x0D]+", by_digest[r["id"], r["digest"]] or ""))
        have.append((r["id"], r["n_words"], r["n_removed"], text if r["kept_text"] is None else r["kept_text"]))
    assert sorted(have, key=repr) == want


def texts(seed, n=60, words=12, most=60):
    """Few words, so that windows repeat inside documents, across them and in long passages."""
    draw = random.Random(seed)
    passages = [[f"w{draw.randrange(words)}" for _ in range(draw.randrange(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [draw.choice(passages) if draw.random() < 0.5 else [f"é{draw.randrange(words)}" for _ in range(draw.randrange(most))] for _ in range(draw.randrange(1, 5))]
        rows.append((draw.choice([i, i, i, None, i // 2]), draw.choice([" ", "  ", "\n", "\t "]).join(w for p in parts for w in p)))
    return [*rows, rows[3], (rows[4][0], rows[5][1])]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("how", [{}, {"bucket_bytes": 0}, {"bucket_bytes": 2000}])
def test_equals_brute_force(spark, seed, how):
    assert_found(spark, texts(seed), 10, seed_words=3, **how)


def test_windows_of_one_word_and_of_the_seed_s_size(spark):
    rows = texts(9, n=20, most=12)
    assert_found(spark, rows, 1, seed_words=1)
    assert_found(spark, rows, 4, seed_words=4)


def test_repeated_words_make_bounded_strings(spark):
    rows = [(1, "a " * 3000), (2, "b " + "a " * 1500 + "c"), (3, "a " * 49), (4, "a " * 50)]
    for how in ({}, {"bucket_bytes": 0}):
        assert_found(spark, rows, 50, **how)


def test_odd_rows(spark):
    got = found(odd(spark))
    assert len(got) == len(ODD) and found(empty(spark)) == []
    rows = [r[:2] for r in ODD]
    assert sorted((r["id"], r["n_words"], r["n_removed"]) for r in got if r["id"] is not None) == sorted(b[:3] for b in brute_force(rows, 50) if b[0] is not None)


def test_rows_without_number_lose_and_do_not_take(spark):
    text = " ".join(f"w{k}" for k in range(60))
    assert_found(spark, [(None, text), (None, text + " x"), (7, "y " + text)], 50)
    assert_found(spark, [(None, text), (None, text + " x")], 50)


def test_op11_equals_its_sql(spark, sf):
    assert SCHEMA.startswith("doc_id")
    assert_same(spark, connection(sf), queries()["op11_substring_dedup"], oracle_sql()["op11_substring_dedup"], sf)
