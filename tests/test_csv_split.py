"""Files with line breaks in values, cut at every byte, against the reader that takes a file as one task."""

import csv
import io
import random

import pytest

from tessera.sources.csv_split import read_split, records
from tessera.sources.files import csv_to_parquet, read_csv

ROWS = [["1", "plain", "x"], ["2", "two\nlines", ""], ["3", 'a "quoted" word', "\n"], ["4", "", '"'], ["5", "é\n\n\n😀,", '""'], ["6", "a,b\r\nc", "end"], ["7", "\n" * 30, "y"], ["8", '"\n"', "z"]]


def text(rows, end="\n", header=("id", "some text", "c")):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def whole(spark, path):
    return spark.read.options(header="true", multiLine="true", escape='"').csv(path)


@pytest.mark.parametrize("size", [2, 16, 61, 10_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_cut_gives_what_one_task_gives(spark, tmp_path, size, end):
    path = tmp_path / "x.csv"
    path.write_bytes(text(ROWS, end).encode())
    if end == "\n":  # that reader changes line ends inside values to those of the file
        assert rows_of(read_split(spark, str(path))) == rows_of(whole(spark, str(path)))
    want = sorted((tuple(r) for r in ROWS), key=repr)
    got = read_split(spark, str(path), range_bytes=size)
    assert got.columns == ["id", "some text", "c"] and sorted((tuple(v or "" for v in r) for r in got.collect()), key=repr) == want
    if size < 100:
        assert records(spark, str(path), size).select("at").distinct().count() > 1


@pytest.mark.parametrize("seed", range(3))
def test_random_files_in_a_folder(spark, tmp_path, seed):
    draw = random.Random(seed)
    want = []
    for k in range(4):
        rows = [[str(i), *("".join(draw.choice('ab",\n ') for _ in range(draw.randrange(0, 40))) for _ in range(2))] for i in range(draw.randrange(0, 40))]
        (tmp_path / f"{k}.csv").write_bytes(text(rows).encode())
        want += [tuple(r) for r in rows]
    got = [tuple(v or "" for v in r) for r in read_split(spark, str(tmp_path), range_bytes=150).collect()]
    assert sorted(got) == sorted(want)


def test_records_keep_their_order(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(text(ROWS).encode())
    got = [r["text"] for r in records(spark, str(path), 9).orderBy("at", "number").collect()]
    assert got == text(ROWS).split("\n", 1)[:1] + [text([r], header=()).lstrip("\n").rstrip("\n") for r in ROWS]


def test_types_empty_files_and_row_groups(spark, tmp_path):
    (tmp_path / "x.csv").write_text(text([[str(i), "a\nb" * 50, "1.5"] for i in range(3000)]))
    got = csv_to_parquet(spark, str(tmp_path / "x.csv"), str(tmp_path / "p"), "zstd", "id int, t string, c double", multi_line=True, row_group_bytes=65_536)
    assert got.dtypes == [("id", "int"), ("t", "string"), ("c", "double")] and got.agg({"id": "sum", "c": "sum"}).first()[:] == (4500.0, 4_498_500) and got.count() == 3000
    import glob

    import pyarrow.parquet as pq

    files = [pq.ParquetFile(x) for x in glob.glob(f"{tmp_path}/p/*.parquet")]
    assert sum(f.num_row_groups for f in files) > len(files) and {f.metadata.row_group(0).column(0).compression for f in files if f.num_row_groups} == {"ZSTD"}
    (tmp_path / "none.csv").write_text("")
    assert read_split(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    head = read_split(spark, str(tmp_path / "head.csv"))
    assert head.columns == ["a", "b"] and head.count() == 0
    (tmp_path / "mark.csv").write_text('﻿Label ,n\n"x\ny",3\n', encoding="utf-8")
    assert tuple(read_csv(spark, str(tmp_path / "mark.csv"), {"label": "string", "n": "int"}, multi_line=True).first()) == ("x\ny", 3)
