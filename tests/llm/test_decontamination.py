"""Passages are found whole: edited ones, short ones, and rows without identifiers."""

import random

import pytest

from tessera.llm.decontamination import Index, Item, best_passage, contaminated, decontaminated, weighted_similarity
from tessera.llm.words import ALNUM, shingles, text_words


def edited(rng, words, kind, n):
    words = list(words)
    if kind == "block":
        at = rng.randrange(len(words) - n)
        del words[at : at + n]
    for _ in range(n if kind != "block" else 0):
        at = rng.randrange(len(words))
        if kind == "delete":
            del words[at]
        elif kind == "insert":
            words.insert(at, f"n{rng.random()}")
        else:
            words[at] = f"n{rng.random()}"
    return words


CASES = [(n, kind, k) for n in (6, 9, 12, 15, 17, 20, 30, 45, 55, 100, 200, 400) for kind in ("block", "delete", "insert", "replace") for k in (1, 2, 3, 5, 10, 20) if k < n // 3]


def test_every_edited_passage_of_the_asked_similarity_is_found():
    rng = random.Random(5)
    asked = missed = 0
    for n, kind, k in CASES:
        for _ in range(12):
            item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            passage = edited(rng, item, kind, k)
            true = weighted_similarity(shingles(text_words(" ".join(passage), ALNUM)), shingles(text_words(" ".join(item), ALNUM)))
            if true < 0.75:
                continue
            around = [[f"d{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] for _ in range(2)]
            text = text_words(" ".join(around[0] + passage + around[1]), ALNUM)
            found = [x for *_, x in Index([(1, " ".join(item))], 3).matches([text], 0.75)]
            asked += 1
            missed += not found
            assert not found or found[0][0] >= true - 1e-12
    print("asked", asked, "missed", missed)
    assert asked > 800 and not missed


def test_the_best_passage_equals_a_scan():
    rng = random.Random(6)
    for _ in range(60):
        item = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(5, 16))]
        text = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(20))] + edited(rng, item, "replace", rng.randrange(2)) + [f"w{rng.randrange(6)}" for _ in range(9)]
        words, known = text_words(" ".join(text), ALNUM), Item(" ".join(item))
        scan = max(weighted_similarity(shingles(words[lo:hi]), known.shingles) for lo in range(len(words)) for hi in range(lo + 5, len(words) + 1))
        got = best_passage(words, shingles(words), known, list(range(len(words))), 0.5)
        assert got[0] == (pytest.approx(scan) if scan >= 0.5 else 0)
        if got[0]:
            assert got[0] == pytest.approx(weighted_similarity(shingles(words[got[1] : got[1] + got[2]]), known.shingles))


@pytest.mark.parametrize("most", [20_000, 0])
def test_edited_passages_are_found_on_both_paths(spark, most):
    rng = random.Random(7)
    items = [(i, [f"w{rng.randrange(10**6)}" for _ in range(n)]) for i, n in enumerate((45, 55, 100, 200))]
    docs = [(i, " ".join(["before", *edited(rng, w, "block", k), "after"])) for (i, w), k in zip(items, (2, 5, 10, 20), strict=True)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert {(r["id"], r["item"]) for r in contaminated(d, b, broadcast_items=most).collect()} == {(i, i) for i in range(4)}


@pytest.mark.parametrize("n", [1, 4, 5, 6, 8, 11, 13, 14])
def test_verbatim_copies_of_short_items_are_found(n):
    rng = random.Random(n)
    for _ in range(60):
        item, before, after = ([f"w{rng.randrange(10**6)}" for _ in range(k)] for k in (n, rng.randrange(30), 30))
        found = list(Index([(1, " ".join(item))], 3).matches([text_words(" ".join(before + item + after), ALNUM)], 0.75))
        assert found == [(0, 0, (1.0, len(before), n))]


@pytest.mark.parametrize("most", [20_000, 0])
def test_rows_without_or_with_shared_identifiers(spark, most):
    item = "the lazy dog while seven grey cats watch from an old stone wall"
    docs = [(None, f"well {item} so"), (None, "quite another text of many words that nobody knows at all"), (None, None), (5, item), (5, "clean"), (6, item)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(None, item), (2, item)], "item_id bigint, text string")
    got = [(r["id"], r["item"], r["first_word"]) for r in contaminated(d, b, broadcast_items=most).collect()]
    assert sorted(got, key=repr) == sorted([(i, k, int(i is None)) for i in (None, 5, 6) for k in (None, 2)], key=repr)
    left = [tuple(r) for r in decontaminated(d, b, broadcast_items=most).collect()]
    assert sorted(left, key=repr) == sorted([docs[1], docs[2], docs[4]], key=repr)
