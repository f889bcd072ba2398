"""Ropes against strings, exact round trips, and the query against its SQL."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.fill_in_middle import CHARS, Rearrangement, built, fill_in_middle, flat, found, joined, leaves, restored, split
from tessera.llm.queries import oracle_sql, queries

from ..parity import assert_same, connection
from .cases import ODD, empty, odd

ALPHABET = "ab <>PSMé😀\n"


def balanced(rope):
    return rope is None or not rope.height or (abs(rope.left.height - rope.right.height) <= 1 and balanced(rope.left) and balanced(rope.right) and rope.size == (rope.left.size[0] + rope.right.size[0], rope.left.size[1] + rope.right.size[1]))


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=200), st.integers(1, 9), st.lists(st.integers(-2, 210), min_size=1, max_size=6))
def test_a_rope_splits_and_joins_as_a_string(text, leaf, cuts):
    rope = built(text, leaf=leaf)
    for cut in cuts:
        a, b = split(rope, cut)
        at = max(0, cut)
        assert (flat(a), flat(b)) == (text[:at], text[at:]) and balanced(a) and balanced(b)
        rope, text = joined(b, a), text[at:] + text[:at]
        assert flat(rope) == text and balanced(rope)
    for mark in ("<P>", "a", "b <"):
        assert found(rope, mark) == text.find(mark)


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=120), st.integers(1, 5), st.integers(0, 130))
def test_units_of_a_pattern_stay_whole(text, leaf, cut):
    unit = re.compile(r"\S+")
    starts = [m.start() for m in unit.finditer(text)]
    rope = built(text, unit, leaf)
    if text:
        assert rope.size == (max(1, len(starts)), len(text))
    a, b = split(rope, cut)
    at = 0 if cut == 0 else starts[cut] if cut < len(starts) else len(text)
    assert (flat(a), flat(b)) == (text[:at], text[at:])
    a, b = split(rope, cut, CHARS)
    assert (flat(a), flat(b)) == (text[:cut], text[cut:])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(0, 10**12)), st.text(ALPHABET, max_size=80), st.sampled_from([None, r"\S+", r"(?s)."]))
def test_every_output_gives_its_text_back(identifier, text, unit):
    how = Rearrangement(percent=100, unit=unit)
    n, form, prefix, middle, output = how.apply(identifier, text)
    assert how.invert(form, output) == text
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>"))
    assert (form == "plain") == plain and (unit == r"\S+" or n == len(text))
    if not plain:
        assert len(output) == len(text) + 9 and prefix + middle <= len(text)


def test_a_long_text_is_many_leaves():
    text = "x" * 1_000_000 + "y"
    rope = built(text)
    assert len(list(leaves(rope))) > 200 and rope.height <= 12
    how = Rearrangement(percent=100)
    _, form, prefix, middle, output = how.apply(3, text)
    assert how.invert(form, output) == text and form in ("psm", "spm")
    with pytest.raises(ValueError, match="no <"):
        how.invert(form, text)


def test_odd_rows(spark):
    got = restored(fill_in_middle(odd(spark), Rearrangement(percent=100))).collect()
    assert len(got) == len(ODD)
    assert sorted((r["restored"] for r in got)) == sorted((r[1] or "") for r in ODD)
    assert all((r["form"] == "plain") == (r["n"] == 0) for r in got)
    assert restored(fill_in_middle(empty(spark))).count() == 0


def test_op12_equals_its_sql(spark, sf):
    assert_same(spark, connection(sf), queries()["op12_fill_in_middle"], oracle_sql()["op12_fill_in_middle"], sf)
