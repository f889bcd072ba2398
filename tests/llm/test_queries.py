"""Every query of the operators on the whole small tables, against brute force, the tokenizers library or held-out rows."""

import json
import zlib
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import language_id, packing, token_counts
from tessera.llm.queries import queries
from tessera.llm.words import ALNUM, shingles, text_words

from . import cases

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_op2_is_right_for_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries()["op2_language_id"](spark, sf).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()}
    assert rows.keys() == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    asked = [i for i, d in docs.items() if rows[i]["held_out"] and d["lang"] is not None and language_id.has_letter(d["text"])]
    right = sum(rows[i]["lang_pred"] == docs[i]["lang"] for i in asked)
    assert len(asked) > 150 and right >= 0.99 * len(asked)
    assert all((r["lang_pred"] == "und") == (not language_id.has_letter(docs[i]["text"])) and 0 <= r["score"] <= 1 for i, r in rows.items())


def test_op2_never_learns_from_held_out_documents(spark):
    """A language that only held-out documents have is never predicted, and neither are others' labels of them."""
    ids = range(400)
    rows = [(i, f"{cases.PROSE} {i}", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "en") for i in ids]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {r["lang_pred"] for r in got.collect()} == {"en"}


def test_op3_equals_brute_force(spark, sf, texts):
    rows = {r["doc_id"]: r for r in queries()["op3_minhash_near_dedup"](spark, sf).collect()}
    want = cases.components([(i, t or "") for i, t in texts.items()])
    assert {i: r["component_id"] for i, r in rows.items()} == want
    assert all(r["n_shingles"] == len(cases.shingle_set(texts[i])) and r["kept"] == (i == want[i]) for i, r in rows.items())


def test_op4_gives_back_the_library_s_ids_and_fills_sequences(spark, sf, texts):
    rows = queries()["op4_best_fit_packing"](spark, sf).collect()
    library = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want = [(k, k * 2048, len(x := ids[k * 2048 : k * 2048 + 2048]), zlib.crc32(array("I", x).tobytes())) for k in range(-(-len(ids) // 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_op6_equals_a_scan_of_all_windows(spark, sf, texts):
    """Every item that stands in a document as it is, and of those found, the similarity of the passage given."""
    rows = queries()["op6_decontamination"](spark, sf).collect()
    items = {r["item_id"]: text_words(r["text"], ALNUM) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    words = {i: text_words(t, ALNUM) for i, t in texts.items()}
    verbatim = {(i, k) for i, w in words.items() for k, x in items.items() if len(x) and any((w[p : p + len(x)] == x).all() for p in range(len(w) - len(x) + 1) if w[p] == x[0])}
    assert verbatim <= {(r["doc_id"], r["item_id"]) for r in rows} and verbatim
    for r in rows:
        passage, item = words[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]], items[r["item_id"]]
        a, b = [list(shingles(x)) for x in (passage, item)]
        shared = sum(min(a.count(x), b.count(x)) for x in set(b))
        assert r["similarity"] == pytest.approx(shared / (len(a) + len(b) - shared)) and r["similarity"] >= 0.75


def test_op8_draws_as_many_as_it_says(spark, sf, texts):
    rows = queries()["op8_quality_classifier"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == texts.keys()
    kept, gone = ([r["gumbel_key"] for r in rows if r["kept"] == k] for k in (True, False))
    assert kept and gone and min(kept) >= max(gone)


def test_op10_equals_the_library(spark, sf, texts):
    rows = {r["doc_id"]: r for r in queries()["op10_token_counts"](spark, sf).collect()}
    library = Tokenizer.from_file(BYTES)
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_packing_keeps_columns_of_any_name(spark):
    pieces = spark.createDataFrame([(i, i % 7 + 1, "a", 1, 2, 3) for i in range(50)], "doc_id bigint, length bigint, first string, end int, n int, first_offset int")
    got = packing.pack(pieces, 10, order=("doc_id",))
    assert got.columns == [*pieces.columns, "sequence_id", "offset"] and got.select(pieces.columns).exceptAll(pieces).isEmpty()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 10").isEmpty() and got.count() == 50


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"model": {"ignore_merges": True}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    spec = json.load(open(BYTES, encoding="utf-8"))
    for k, v in change.items():
        spec[k] = {**spec[k], **v} if isinstance(spec[k], dict) else v
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="unsupported"):
        token_counts.TokenCounter(str(tmp_path / "other.json"))


def test_a_tokenizer_that_joins_words_is_used_on_whole_texts():
    text = "Two words, and  a longer\nline"
    for path in (WORDS, BYTES):
        encoder = packing.WordEncoder(path)
        assert encoder.by_word == (path == WORDS)
        assert encoder.encode([text, ""]) == [array("I", Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids).tobytes() for x in (text, "")]
