"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names: every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import compaction, decontamination, exact_dedup, language_id, license_scan, minhash, packing, pii, quality, token_counts
from tessera.llm.shared import written

from .cases import ODD, PROSE, empty, odd

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def benchmark(spark):
    return spark.createDataFrame([(1, "the lazy dog while seven grey cats watch from an old stone wall"), (2, None), (3, "")], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (10, 0, 0), (None, 1, 0), (9, 0, None), (2, None, 0)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "pii": lambda s, d: pii.personal_data(d),
    "language": lambda s, d: language_id.identified(d),
    "near": lambda s, d: minhash.near_duplicates(d),
    "license": lambda s, d: license_scan.license_scan(d),
    "quality": lambda s, d: quality.quality_verdicts(d, labels(s)),
    "exact": lambda s, d: exact_dedup.exact_duplicates(d),
    "tokens": lambda s, d: token_counts.token_counts(d, BYTES),
}
STAGES = {
    "near": lambda s, d: minhash.one_of_each_group(d),
    "exact": lambda s, d: exact_dedup.distinct_documents(d),
    "quality": lambda s, d: quality.good_documents(d, labels(s)),
    "decontamination": lambda s, d: decontamination.decontaminated(d, benchmark(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    assert OPERATORS[name](spark, odd(spark)).count() == len(ODD)
    assert OPERATORS[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(spark, name):
    got = STAGES[name](spark, odd(spark))
    assert got.columns == odd(spark).columns and 0 < got.count() <= len(ODD)
    assert STAGES[name](spark, empty(spark)).count() == 0


def test_exact_stage_gives_rows_given_twice_once(spark):
    got = STAGES["exact"](spark, odd(spark)).select("doc_id", "text").collect()
    assert len({r["text"] for r in got}) == len(got) - sum(r["text"] is None for r in got) + (None in [r["text"] for r in got])
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 3, 4, 6, 7, 8, 9, 10, 11, 12, 12, 13]


def test_near_stage(spark):
    got = STAGES["near"](spark, odd(spark)).select("doc_id").collect()
    ids = [r["doc_id"] for r in got]
    assert 2 not in ids and 3 not in ids and 7 not in ids and 1 in ids and 6 in ids and ids.count(None) == 2


@pytest.mark.parametrize("most", [{}, {"broadcast_items": 0}, {"broadcast_bytes": 1}])
def test_decontamination_finds_the_item_in_every_copy(spark, most):
    found = decontamination.contaminated(odd(spark), benchmark(spark), **most).collect()
    assert sorted(((r["id"] is not None, r["id"] or 0), r["item"]) for r in found) == [((False, 0), 1), ((True, 1), 1), ((True, 2), 1), ((True, 2), 1), ((True, 3), 1)]
    clean = decontamination.decontaminated(odd(spark), benchmark(spark), **most).select("doc_id").collect()
    assert len(clean) == len(ODD) - 5 and sum(r["doc_id"] is None for r in clean) == sum(r[0] is None for r in ODD) - 1
    assert decontamination.contaminated(empty(spark), benchmark(spark), **most).count() == 0
    assert decontamination.contaminated(odd(spark), benchmark(spark).limit(0)).count() == 0


def test_packing(spark):
    for docs, n in ((odd(spark), len(ODD)), (empty(spark), 0)):
        got = packing.packed_documents(docs, WORDS, capacity=512)
        assert got.filter("piece = 0").count() == n
    over = packing.pack(written(packing.token_pieces(odd(spark), WORDS, 512), "pieces"), 512).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("o"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert over.filter("n > 512 or o <> 0 or e <> n").isEmpty()


def test_sharding(spark, tmp_path):
    store = compaction.sharded(odd(spark), str(tmp_path / "s"), arrivals=2, fanout=2)
    back = store.read().drop("__shard")
    assert back.exceptAll(odd(spark)).isEmpty() and back.count() == len(ODD)
    assert compaction.sharded(empty(spark), str(tmp_path / "e")).manifest()["runs"] == []


def test_a_text_is_only_its_own_language(spark):
    rows = spark.createDataFrame([(i, (PROSE if i % 2 else "le petit chat dort sur la chaise près de la fenêtre ouverte"), "en" if i % 2 else "fr") for i in range(200)], "doc_id bigint, text string, lang string")
    got = language_id.identified(rows).join(rows.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert got.filter("lang <> lang_pred or score < 0.5").isEmpty()
