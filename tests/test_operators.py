"""Incremental operators, sources and plans on rows made by hand."""

import datetime as dt
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import incremental as I
from tessera.operators import relational as R
from tessera.operators.search import close_pairs, closest_names
from tessera.plans.attribution import week_market
from tessera.plans.catalog import QUERIES
from tessera.functions.curves import nnls
from tessera.plans.shares import first_weeks
from tessera.sources import files
from tessera.sources.tables import Tables

D = dt.date


def test_upsert_is_idempotent_and_partial_updates_keep_the_rest(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, n int")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 30)], "k int, name string, n int")
    once = I.merge_upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 10), (2, "c", 99), (3, "d", 30)]
    assert sorted(map(tuple, I.merge_upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    partial = I.merge_upsert(old, new, ["k"], ["name"])
    assert sorted(map(tuple, partial.collect())) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]


def test_versioned_table_reads_itself_while_it_is_upserted(spark, tmp_path):
    t = I.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.upsert(spark.createDataFrame([(1, "a")], "k int, x string"), ["k"])
    assert t.upsert(spark.createDataFrame([(1, "b"), (2, "c")], "k int, x string"), ["k"]) == 2
    assert sorted(map(tuple, t.read().collect())) == [(1, "b"), (2, "c")]


def test_versions_survive_crashes_and_two_writers(spark, tmp_path):
    at, rows = str(tmp_path / "t"), lambda x: spark.createDataFrame([(1, x)], "k int, x string")
    one, two = I.VersionedTable(spark, at), I.VersionedTable(spark, at)
    one.write(rows("a")), one.write(rows("b"))
    (tmp_path / "t" / "pointers" / ".left").mkdir()  # a writer that died before its rename
    (tmp_path / "t" / "v3-left").mkdir()
    assert two.current() == 2 and two.read().first()["x"] == "b" and two.read(1).first()["x"] == "a"
    one.current = lambda: 2  # has looked before the other writes
    assert two.write(rows("c")) == 3
    with pytest.raises(I.Conflict):
        one.write(rows("d"))
    assert two.read().first()["x"] == "c"
    two.vacuum(keep=1)
    assert two.read().first()["x"] == "c" and two.current() == 3 and not (tmp_path / "t" / "pointers" / "000000001").exists()
    assert two.write(rows("e")) == 4  # never again from v1


def test_refresh_only_if_the_source_has_advanced(spark):
    row = lambda d, x: spark.createDataFrame([(D(2024, 1, d), x)], "d date, x string")
    assert [I.refreshed_if_advanced(row(4, "old"), row(d, "new"), "d").first()["x"] for d in (3, 4, 5)] == ["old", "old", "new"]
    assert I.refreshed_if_advanced(row(4, "old").limit(0), row(5, "new"), "d").first()["x"] == "new"


@pytest.mark.parametrize(("as_of", "weeks"), [(D(2024, 1, 12), 1), (D(2024, 1, 14), 1), (D(2024, 1, 15), 2)])
def test_the_week_in_progress_is_left_out(spark, as_of, weeks):
    series = spark.createDataFrame([(1, D(2024, 1, 4)), (1, D(2024, 1, 11))], "k int, week_end date")
    assert I.without_partial_week(series, ["k"], "week_end", F.lit(as_of)).count() == weeks


def names(seed, n):
    draw = random.Random(seed)
    letters = draw.choice(["ab", "abcdefgh ", "aé😀ß1#", "abcdefghijklmnopqrstuvwxyz 0123456789"])
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("cutoff", "n"), [(0.8, 1), (0.55, 10), (1.0, 2)])
def test_closest_names_equal_a_scan(spark, seed, cutoff, n):
    from difflib import SequenceMatcher

    known, asked = names(seed, 70), names(seed + 100, 40)
    asked += [k[:4] + k[5:] for k in known[:20]] + known[:5]
    got = {}
    for r in closest_names(*(spark.createDataFrame([(x,) for x in [*some, None, some[0]]], "name string") for some in (known, asked)), cutoff, n, first=2).collect():
        got.setdefault(r["asked"], {})[r["place"]] = (r["score"], r["known"])
    for a in {*asked} - {""}:
        scores = sorted(((SequenceMatcher(None, k, a).ratio(), k) for k in {*known} - {""}), reverse=True)
        want = [x for x in scores if x[0] >= cutoff][:n]
        assert [got.get(a, {})[k] for k in sorted(got.get(a, {}))] == want


def test_only_pairs_that_can_pass_are_compared(spark):
    known, asked = names(3, 300), names(7, 300)
    frames = [spark.createDataFrame([(x,) for x in some], "name string") for some in (known, asked)]
    got = [(r["known"], r["asked"]) for r in close_pairs(*frames, 0.8).collect()]
    assert len(got) == len(set(got)) and all(SequenceMatcher(None, k, a).quick_ratio() >= 0.8 - 1e-9 for k, a in got)
    assert {(k, a) for k in known for a in asked if k and a and SequenceMatcher(None, k, a).quick_ratio() >= 0.8} <= set(got)


def common_in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_names_of_the_same_characters_in_another_order_are_not_compared():
    """Every asked name has the characters of every known one, so common characters alone would let each pair through."""
    from tessera.operators.search import InOrder

    known = sorted((f"Supplier#{x:09d}" for x in (12345, 12354, 13245, 54321, 51432)), reverse=True)
    asked = [x[::-1] + "?" for x in known] + [known[2], "", "é" * 70 + "Supplier", "Supplier#0000" * 8]
    got = np.concatenate(list(InOrder(known).bounds(asked)))
    assert (got[:5] < 0.55).all() and got[5].argmax() == 2 and (got[5] == 1).sum() == 1
    for a, row in zip(asked, got):
        for k, bound in zip(known, row):
            most = min(common_in_order(a[:64], k) + max(len(a) - 64, 0), len(k))
            assert bound == pytest.approx(2 * most / (len(a) + len(k))) and bound >= SequenceMatcher(None, k, a).ratio() - 1e-9


def test_every_misspelt_supplier_and_brand_equals_a_scan(spark, sf):
    from tessera.plans.refresh import misspelt

    known, asked = ([r["name"] for r in x.collect()] for x in misspelt(Tables(spark, sf)))
    got = {}
    for r in QUERIES["fuzzy_names"](spark, sf).collect():
        got.setdefault(r["asked"], []).append((r["place"], r["rung"], r["known"], r["score"]))
    rungs = set()
    for a in set(asked):
        same = min((k for k in known if k.strip().lower() == a.strip().lower()), default=None)
        scores = sorted(((SequenceMatcher(None, k, a).ratio(), k) for k in set(known)), reverse=True)
        if same is not None:
            want = [(1, "exact", same, 1.0)]
        elif scores[0][0] >= 0.8:
            want = [(1, "close", scores[0][1], round(scores[0][0], 9))]
        else:
            want = [(p, "alike", k, round(s, 9)) for p, (s, k) in enumerate(scores[:10], 1) if s >= 0.55] or [(1, "none", None, None)]
        assert sorted(got[a]) == want
        rungs.add(want[0][1])
    assert rungs == {"exact", "close", "alike", "none"}


def test_fill_missing_takes_only_blank_values(spark):
    target = spark.createDataFrame([(1, " "), (2, "x"), (3, None)], "k int, v string")
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, I.fill_missing(target, source, ["k"], ["v"]).collect())) == [(1, "a"), (2, "x"), (3, "c")]


def test_anchor_of_an_empty_table_is_the_cold_start(spark):
    assert I.anchor(spark.createDataFrame([], "d date"), "d").first()[0] == D(2018, 1, 1)


def test_page_looks_one_row_ahead(spark):
    rows = spark.range(5)
    last = R.page(rows, [F.col("id")], 2, 4).collect()
    assert [(r["id"], r["has_more"], r["next_offset"]) for r in last] == [(4, False, None)]
    assert all(r["has_more"] and r["next_offset"] == 4 for r in R.page(rows, [F.col("id")], 2, 2).collect())


@pytest.mark.parametrize(("second", "volume", "week", "skipped"), [(D(2024, 1, 11), 90000.0, D(2024, 1, 11), True), (D(2024, 1, 18), 90000.0, D(2024, 1, 4), False)])
def test_a_stub_first_week_is_skipped_only_if_the_next_follows(spark, second, volume, week, skipped):
    weeks = spark.createDataFrame([(1, D(2024, 1, 4), 500.0), (1, second, volume)], "title_id int, week_end date, ae double")
    got = first_weeks(weeks, spark.createDataFrame([(1, D(2024, 1, 4))], "title_id int, street date")).first()
    assert (got["week_end"], got["skipped_stub"]) == (week, skipped)


def test_effects_add_up_to_the_change_in_share(spark, sf):
    x = week_market(Tables(spark, sf)).filter("prev_share is not null")
    assert x.filter("abs(own_effect_bps + market_effect_bps - d_share_bps) > 1e-6").isEmpty()


def test_csv_contract(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿ Label , Old_Name,n\n"a\nb",x,1\nc,y,none\n', encoding="utf-8")
    got = files.read_csv(spark, str(path), {"label": "string", "new_name": "string", "n": "int"}, {"new_name": ["old_name"]}, multi_line=True)
    assert sorted(map(tuple, got.collect())) == [("a\nb", "x", 1), ("c", "y", None)]
    with pytest.raises(files.MissingColumns):
        files.read_csv(spark, str(path), {"absent": "string"})


def test_csv_to_parquet_and_document(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n"1\n2",x\n')
    assert files.csv_to_parquet(spark, str(tmp_path / "x.csv"), str(tmp_path / "p"), multi_line=True).first()["a"] == "1\n2"
    files.write_document(spark.createDataFrame([('{"a":1}',)], "value string"), str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{"a":1}'
    files.write_document(spark.createDataFrame([('{"a":2}',)], "value string"), str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{"a":2}' and not list(tmp_path.glob("*.tmp"))


def test_json_records_round_half_to_even(spark):
    rows = spark.createDataFrame([(0.125, 2.5, float("nan"))], "share double, n double, x double")
    assert files.json_records(rows, ["share"]).first()[0] == '{"share":0.13,"n":2,"x":null}'


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 5), min_size=3, max_size=3))
def test_nnls_finds_the_weights_of_an_exact_mix(weights):
    a = np.random.default_rng(3).random((20, 3))
    assert np.allclose(nnls(a, a @ np.array(weights)), weights, atol=1e-6)


def test_weighted_sample_prefers_heavy_rows(spark):
    rows = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 1.0).otherwise(20.0))
    got = R.weighted_sample(rows, F.col("w"), 300, "id")
    assert got.count() == 300 and got.filter("id >= 1000").count() > 240


def test_temporary_tables_go_and_kept_ones_stay(spark):
    from tessera.sources.stored import list_names, new_path, shared_dir, temporary, written, written_at

    before = set(list_names(spark, shared_dir(spark)))
    with temporary(spark) as outer:
        with temporary(spark) as keep:
            one = written(spark.range(5), "one")
            two = written_at(one, keep(new_path(spark, "two")))
        assert two.count() == 5 and {x.split("-")[0] for x in set(list_names(spark, shared_dir(spark))) - before} == {"two"}
        three = written_at(two, outer(new_path(spark, "three")))
    assert three.count() == 5 and {x.split("-")[0] for x in set(list_names(spark, shared_dir(spark))) - before} == {"three"}
    with pytest.raises(KeyError), temporary(spark):
        written(spark.range(5), "four")
        raise KeyError
    assert not any(x.startswith("four") for x in list_names(spark, shared_dir(spark)))


@pytest.mark.parametrize(("rows", "columns"), [(60, 40), (40, 60), (30, 3)])
def test_nnls_of_many_columns_is_at_its_minimum(rows, columns):
    draw = np.random.default_rng(rows)
    a = np.abs(draw.normal(size=(rows, columns)))
    for b in (a @ np.maximum(draw.normal(size=columns), 0), draw.normal(size=rows), np.zeros(rows)):
        x = nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() <= 1e-7 * max(1, np.abs(b).max()) and np.abs(slope[x > 0]).max(initial=0) <= 1e-7 * max(1, np.abs(b).max())


def test_names_meet_in_blocks(spark, monkeypatch):
    """A block of names beside a block, whose products bound all pairs; no row for each character that two names share."""
    from tessera.operators import search

    known, asked = names(11, 60), names(12, 60)
    assert (search._bounds(known[:0] + ["abca"], ["aab", "x"]) == [[2 * 3 / 7], [0.0]]).all()
    monkeypatch.setattr(search, "BLOCK", 16)
    frames = [spark.createDataFrame([(x,) for x in some], "name string") for some in (known, asked)]
    assert search._blocks(search._named(frames[0])).count() > 1
    best = {a: max((SequenceMatcher(None, k, a).ratio(), k) for k in known if k) for a in asked if a}
    assert {(r["asked"], r["score"], r["known"]) for r in closest_names(*frames, 0.6).collect()} == {(a, *x) for a, x in best.items() if x[0] >= 0.6}
