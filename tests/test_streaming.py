"""Streaming twins of a table of many files whose times overlap."""

import pytest

from tessera.plans.catalog import ORACLE, QUERIES

from .parity import assert_same, connection


@pytest.fixture(scope="module")
def many_files(spark, sf, tmp_path_factory):
    directory = str(tmp_path_factory.mktemp("many"))
    spark.read.parquet(f"{sf}/events.parquet").repartition(6).write.parquet(f"{directory}/events.parquet")
    return directory


@pytest.mark.parametrize("name", ["stream_weekly", "stream_dedupe"])
def test_no_row_is_late_in_a_table_of_many_files(spark, many_files, name):
    assert_same(spark, connection(many_files), QUERIES[name], ORACLE[name], many_files)


def test_a_late_correction_wins_whatever_its_values(spark, tmp_path):
    from tessera.operators.incremental import VersionedTable
    from tessera.streaming.weekly import upsert_each_batch

    schema = "k int, seq int, n int"
    batches = ([(1, 1, 100), (2, 1, 5), (2, 2, 3)], [(1, 2, 40), (3, 1, 1)], [(1, 3, 70), (2, 1, 99)])
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_each_batch(stream, target, ["k"], checkpoint, "seq")
    assert sorted(map(tuple, VersionedTable(spark, target).read().collect())) == [(1, 3, 70), (2, 2, 3), (3, 1, 1)]
