"""Columns and windows on rows made by hand."""

import datetime as dt
import re
import sys
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import windows as W
from tessera.functions.folding import code_class, folded
from tessera.functions.text import search_text_exact, similarity

D = dt.date


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'date' if isinstance(v, D) else 'string'}" for k, v in values.items()))
    return rows.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [(1.0, 0.0, 0.0), (1.0, 4.0, 0.25), (None, 0.0, None), (None, 2.0, None)])
def test_div0(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a double, b double").select(C.div0("a", "b")).first()[0] == want


def test_truncation_does_not_round(spark):
    assert one(spark, C.trunc2("x"), x=8.859) == 8.85
    assert one(spark, C.trunc2("x"), x=8.85) == 8.85


@pytest.mark.parametrize("x", [0.085, 8.5, 850.0])
def test_share_units_row_by_row(spark, x):
    assert one(spark, C.share_fraction("x"), x=x) == pytest.approx(0.085)


@pytest.mark.parametrize(("day", "want"), [(D(2024, 8, 29), D(2024, 8, 22)), (D(2024, 8, 30), D(2024, 8, 29))])
def test_expected_week_is_the_thursday_before(spark, day, want):
    assert one(spark, C.expected_week("d"), d=day) == want


@pytest.mark.parametrize(("day", "want"), [(D(2024, 1, 4), D(2024, 1, 4)), (D(2024, 1, 5), D(2024, 1, 11))])
def test_week_end(spark, day, want):
    assert one(spark, C.week_end("d"), d=day) == want


@pytest.mark.parametrize(("day", "fy", "fm", "label"), [(D(2024, 9, 28), 2025, 1, "Sep - (END Sep 28)"), (D(2024, 8, 31), 2024, 12, "Aug")])
def test_fiscal_calendar(spark, day, fy, fm, label):
    assert (one(spark, C.fiscal_year("d"), d=day), one(spark, C.fiscal_month("d"), d=day), one(spark, C.fiscal_month_label("d"), d=day)) == (fy, fm, label)


def test_rows_since_counts_from_one_before_the_first_flag(spark):
    rows = spark.createDataFrame(list(enumerate([0, 0, 1, 0, 0])), "k int, flag int").withColumn("g", F.lit(1))
    got = W.rows_since(rows, F.col("flag") == 1, ["g"], ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == [1, 2, 0, 1, 2]


def test_fill_goes_forward_then_back(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7)], "k int, x int")
    got = rows.select("k", W.filled(F.col("x"), Window.orderBy("k")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got] == [5, 5, 5, 7]


def test_rolling_median_needs_enough_rows(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(1, 6)], "k int, x double")
    got = rows.select(W.rolling_median(F.col("x"), Window.orderBy("k"), 3, 2).alias("m"), "k").orderBy("k").collect()
    assert [r["m"] for r in got] == [None, None, 1.5, 2.0, 3.0]


def test_search_text(spark):
    assert one(spark, search_text_exact("x"), x="  Beyoncé — ÉTÉ!! ﬁn_1 ") == "beyonce ete fin 1"
    assert one(spark, C.search_text("x"), x="Beyoncé — ÉTÉ!!") == "beyonce ete"
    assert one(spark, similarity(F.col("a"), F.col("b")), a="untitled unmastered", b="unmastered untitled") == 1.0


def test_owner_case(spark):
    rows = spark.createDataFrame([("A", "x"), ("A", "y"), (None, "z"), ("B", None)], "l1 string, l2 string")
    assert [r[0] for r in rows.select(C.owner_case("l1", "l2", ["x"], {"y": "x"})).collect()] == ["x", "x", "Unknown", "B"]


def test_first_part_takes_the_first_separator_of_the_list(spark):
    assert one(spark, C.first_part("x"), x="a; b, c") == "a; b"


def test_categories_are_filtered_in_the_scan(spark, sf):
    from tessera.sources.tables import Tables

    t = Tables(spark, sf)
    for wanted in ("Streams", "RecordingSales", ("ProductSales", "RecordingSales")):
        names = [wanted] if isinstance(wanted, str) else list(wanted)
        assert t.facts(wanted).exceptAll(t.daily_fact.filter(F.col("category").isin(names))).isEmpty() and t.facts(wanted).count() == t.daily_fact.filter(F.col("category").isin(names)).count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = t.facts("Streams", "OnDemand").filter("report_date >= date'2001-06-01'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(l_returnflag,A)" in plan and "EqualTo(l_linestatus,F)" in plan
    assert t.panel_since("1998-01-01").exceptAll(t.panel.filter("week_end >= '1998-01-01'")).isEmpty() and t.panel_since("1998-01-01").count() == t.panel.filter("week_end >= '1998-01-01'").count()


def plain_search_text(s):
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w]|_", " ", plain.lower()).split())


def test_folding_equals_the_unicode_tables_for_every_assigned_code_point(spark):
    assert code_class([1, 2, 3, 7, 65]) == "\\x{1}-\\x{3}\\x{7}\\x{41}"
    points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) not in ("Cn", "Co")]
    rows = spark.createDataFrame(pd.DataFrame({"p": points, "x": [f"a{chr(p)}b {chr(p)}" for p in points]}))
    got = rows.select("p", folded("x").alias("y")).toPandas()
    want = [plain_search_text(f"a{chr(p)}b {chr(p)}") for p in got.p]
    assert len(got) > 140_000 and [p for p, a, b in zip(got.p, got.y, want) if a != b] == []


def test_folding_of_every_document_and_of_nothing(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["", None, " _ ", "\u0301", "ﬁ Ω ²½ İ ẞ ΑΣ Σ"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", folded("x").alias("y")).collect()
    assert {r["i"]: r["y"] for r in got} == {i: None if t is None else plain_search_text(t) for i, t in enumerate(texts)}
