"""Queries over all rows: older names, whole texts, all titles."""

import re

import pytest

from tessera.plans.catalog import ORACLE, QUERIES

from .parity import connection, rows

ASKED = " WHERE title_id % 20 = 0"


@pytest.mark.parametrize("name", ["first_week_resolver", "join_range_band", "stitched_series"])
def test_older_names_equal_the_sql(spark, sf, name):
    """Of the search join_range_band the SQL asks for the titles of the stated query set, the older name for all."""
    assert (ASKED in ORACLE[name]) == (name == "join_range_band") and ORACLE[name].count("title_id %") == (name == "join_range_band")
    want = connection(sf).sql(ORACLE[name].replace(ASKED, ""))
    got = QUERIES[f"{name}_all"](spark, sf)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_title_with_a_long_history_has_a_forecast(spark, sf):
    want = connection(sf).sql(f"SELECT title_id FROM ({ORACLE['stitched_series']}) WHERE kind = 'history' GROUP BY 1 HAVING count(*) >= 12").fetchall()
    got = QUERIES["archetype_forecast"](spark, sf).select("title_id").distinct().collect()
    assert {r["title_id"] for r in got} == {x for (x,) in want} and any(x % 20 for (x,) in want)


def test_whole_texts_are_normalised(spark, tmp_path):
    docs = [(1, "Señor  Élan-vital!\n" * 400 + "END"), (2, None), (3, ""), (4, "—?—"), (5, "x" * 5000 + " Y")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table = str.maketrans("éñ", "en")
    want = {i: None if x is None else re.sub(r"[\W_]+", " ", x.lower().translate(table)).strip() for i, x in docs}
    for name in ("str_normalize", "str_normalize_whole"):
        assert {r["doc_id"]: r["search"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == want
    assert want[1].endswith(" end") and len(want[1]) > 4000


def test_shapes_hold_a_year(spark, sf):
    from tessera.plans.forecast import shape_vectors
    from tessera.sources.tables import Tables

    x = shape_vectors(Tables(spark, sf))
    assert [c for c in x.columns if c != "title_id"] == [f"w{k}" for k in range(1, 53)]
    assert x.filter(" + ".join(f"w{k}" for k in range(13, 53)) + " > 0").count() > 0


def test_stitched_series_need_no_order_of_their_rows(spark, sf):
    plan = QUERIES["stitched_series"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" not in plan and "pri#" not in plan


def test_shapes_are_made_once_and_titles_dealt_by_the_size_of_the_sources(spark, sf, monkeypatch):
    """the fit reads stored vectors; weeks of titles are dealt once, over tasks that grow with the sources."""
    from tessera.plans.features import life
    from tessera.sources import tables

    assert all("shape-vectors" in f for f in QUERIES["kmeans_archetypes"](spark, sf).inputFiles())
    monkeypatch.setattr(tables, "TITLE_TASK_BYTES", 20_000)
    t = tables.Tables(spark, sf)
    n = -(-t.signature[1] // 20_000)
    assert n > 4 and t.title_facts.rdd.getNumPartitions() == n
    plan = life(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def copied(spark, sf, folder, **instead):
    """A folder with the tables of ``sf``, some of them replaced."""
    for name in ("region", "nation", "supplier", "part", "lineitem", "orders", "customer"):
        instead.get(name, spark.read.parquet(f"{sf}/{name}.parquet")).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_owners_are_ranked_where_titles_are(spark, sf, tmp_path):
    """facts are dealt by title only; a product without a supplier is passed over, a supplier named twice counts once."""
    from tessera.plans.domain import title_floor
    from tessera.sources.tables import Tables

    best = Tables(spark, sf).owners.groupBy("product_id").count().orderBy("count", ascending=False).first()["product_id"]
    s = spark.read.parquet(f"{sf}/supplier.parquet").filter(f"s_suppkey <> {best}")
    d = copied(spark, sf, tmp_path, supplier=s.unionByName(s.limit(1)))
    want = connection(d).sql(ORACLE["q_01_title_weeks"])
    got = QUERIES["q_01_title_weeks"](spark, d)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
    plan = title_floor(Tables(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3


def test_certification_reads_stored_shapes(spark, sf):
    """the floors read a stored row for each title instead of the panel three times."""
    assert all("certification-shapes" in f for f in QUERIES["certification_titles"](spark, sf).inputFiles())


def test_weeks_of_the_catalogue_are_not_dealt_by_artist(spark, sf):
    """F16: an artist's median is joined to titles; the yearly median sorts without a comparator."""
    plan = QUERIES["catalog_frame"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.index("Join Inner, (title_id") < plan.index("Join Inner, (artist")


def test_runs_of_other_signs_are_one_space_in_one_pass(spark, tmp_path):
    """spaces that stay are not replaced, and no pass joins them afterwards."""
    texts = ["a b", " a  b ", "a , b", "a\tb\u00a0c", "é è", " é", "a \u0301b", "x -", "  ", ". a", "a. 1\n\n2", "Ä\u2028ß \u4e2d\u6587 q", ", " * 30_000 + "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    x = QUERIES["str_normalize_whole"](spark, str(tmp_path))
    want = ["a b", "a b", "a b", "a b c", "e e", "e", "a b", "x", "", "a", "a 1 2", "a ß \u4e2d\u6587 q", "z"]
    assert [r["search"] for r in x.orderBy("doc_id").collect()] == want
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
