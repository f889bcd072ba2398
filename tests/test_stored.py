"""Tables that several queries share: made once, again when a source changes, and gone by age and number."""

import os
import shutil

import pytest

from tessera.plans.catalog import QUERIES
from tessera.sources import stored as S
from tessera.sources.tables import SOURCES, Tables


@pytest.fixture
def own(spark, sf, tmp_path):
    """The tables in a folder of their own, as files that may be touched."""
    for name in SOURCES:
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
        os.chmod(tmp_path / f"{name}.parquet", 0o644)
    return str(tmp_path)


def counted(made):
    def make(t, name):
        def run():
            made.append(name)
            return t.raw("nation")

        return t.stored(name, run)

    return make


def test_made_once_for_all_that_ask(spark, own):
    made = []
    make = counted(made)
    one, two = (make(Tables(spark, own), "nations") for _ in range(2))
    assert made == ["nations"] and one.count() == two.count() == 25
    make(Tables(spark, own), "others")
    assert made == ["nations", "others"]


@pytest.mark.parametrize("name", SOURCES)
def test_a_changed_file_makes_it_anew(spark, own, name):
    made = []
    make = counted(made)
    make(Tables(spark, own), "nations")
    path = f"{own}/{name}.parquet"
    os.utime(path, (os.path.getatime(path), os.path.getmtime(path) + 5))
    make(Tables(spark, own), "nations")
    make(Tables(spark, own), "nations")
    assert made == ["nations"] * 2


def test_what_was_deleted_is_made_anew(spark, own):
    made = []
    make = counted(made)
    make(Tables(spark, own), "nations")
    S.drop_path(spark, list(S._shared.values())[-1][1])
    assert make(Tables(spark, own), "nations").count() == 25 and len(made) == 2


def test_gone_by_age_and_number(spark, own, monkeypatch):
    made = []
    make = counted(made)
    for name in "abc":
        make(Tables(spark, own), name)
    paths = {k[-1]: v[1] for k, v in S._shared.items() if k[-1] in "abc"}
    monkeypatch.setattr(S, "SHARED_MOST", 2)
    make(Tables(spark, own), "c")
    assert [bool(S.list_names(spark, paths[x])) for x in "abc"] == [False, True, True] and made == ["a", "b", "c"]
    monkeypatch.setattr(S, "SHARED_SECONDS", -1)
    make(Tables(spark, own), "c")
    assert made == ["a", "b", "c", "c"] and not S.list_names(spark, paths["b"])


def test_the_second_query_of_a_report_reads_no_source(spark, own):
    def read(plan):
        return f"{own}/lineitem.parquet" in plan

    rows = {}
    for _ in range(2):
        df = QUERIES["attr_coverage"](spark, own)
        rows.setdefault("rows", []).append(sorted(map(tuple, df.collect()), key=repr))
    assert rows["rows"][0] == rows["rows"][1]
    before = dict(S._shared)
    second = QUERIES["attr_titles_gated"](spark, own)
    assert set(S._shared) == set(before) and not any(read(x) for x in second.inputFiles())


def test_not_one_of_the_temporary_around(spark, own):
    with S.temporary(spark):
        t = Tables(spark, own).stored("inside", lambda: Tables(spark, own).raw("region"))
    assert t.count() == 5
