"""Operators against brute force, the tokenizers library and round trips."""

import hashlib
import random
import re
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import compaction, exact_dedup, license_scan, minhash, pii, quality
from tessera.llm.components import components
from tessera.llm.decontamination import Index, contaminated, weighted_similarity
from tessera.llm.packing import WordEncoder, plan
from tessera.llm.queries import oracle_sql, queries
from tessera.llm.token_counts import TokenCounter
from tessera.llm.words import ALNUM, text_words
from tests.parity import assert_same, connection

from . import cases

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "s", "t", "'", "'", "r", "e", "v", "l", "d", "m", " ", " ", "\n", "\t", "1", "é", "ß", "中", "!", "?", "́", "😀", "<|endoftext|>", "ll", "the", "ing", "\x1c", "\x85", "٣", "Ⅷ", "²", "<|startoftext|>", "<|", "A", "S", "İ", "Σ", "\r", " ", "ﬁ"]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(BYTES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join))
def test_token_counts_equal_the_library(counter, text):
    assert counter.counts([text, "", text])[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)


LIBRARY = Tokenizer.from_file(BYTES)


def test_token_counts_of_long_runs(counter):
    texts = ["a" * 5000, " " * 3000, "!" * 777, "ab" * 2000 + " 's're'", "\n \n" * 500]
    assert counter.counts(texts) == [len(x.ids) for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join))
def test_word_ids_equal_the_library(text):
    assert ENCODER.encode([text]) == [array("I", ENCODER.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()]


ENCODER = WordEncoder(WORDS, limit=200)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_gives_every_piece_one_place_without_gaps(counts):
    used = Counter()
    for s in plan(counts, 64):
        for rank in range(s.first, s.end):
            sequence, offset = s.sequence_id + (rank - s.first) // s.per_sequence, s.offset + (rank - s.first) % s.per_sequence * s.length
            for k in range(offset, offset + s.length):
                used[sequence, k] += 1
    assert all(n == 1 and k < 64 for (_, k), n in used.items()) and len(used) == sum(k * v for k, v in counts.items())
    filled = Counter(s for s, _ in used)
    assert all((s, k) in used for s, n in filled.items() for k in range(n))
    rooms = []  # best-fit decreasing, piece by piece
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fitting = [r for r in rooms if r >= length]
        room = min(fitting) if fitting else 64
        if fitting:
            rooms.remove(room)
        rooms.append(room - length)
    assert len(filled) == len(rooms)


PATTERNS = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_by_patterns(text):
    def ok(kind, match):
        digits = [int(c) for c in match if c in "0123456789"]
        if kind == 1:
            return all(int(x) <= 255 for x in match.split("."))
        if kind == 2:
            total = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if ok(k, m.group()))


@settings(max_examples=300, deadline=None)
@given(st.text("a@.-+ 1203()%_é9", max_size=50))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == base_by_patterns(text)


def test_the_field_adds_what_its_twin_says(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(-1, "call +1 (988) 555-2485 now, or later (988) 555-2485 again"), (-2, "version 12 of 34 things")], docs.schema)
    got = {r["id"]: r for r in pii.personal_data(docs.unionByName(own)).filter("id < 0").collect()}
    assert len(got[-1]["base"]) == 1 and [(s["start"], s["end"]) for s in got[-1]["spans"]] == [(5, 22), (37, 51)]
    assert not got[-2]["spans"]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 40, 120]))]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            k += 1
            rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = cases.components(rows)
    for bucket_rows in (1024, 3):
        got = minhash.near_duplicates(docs, bucket_rows=bucket_rows).collect()
        assert {r["id"]: r["component_id"] for r in got} == want
        assert {r["id"]: r["n_shingles"] for r in got} == {i: len(cases.shingle_set(t)) for i, t in rows}


def test_tiles_bring_every_two_rows_of_different_components_together(spark):
    rng = random.Random(2)
    rows = [(7, i, 0 if i < 40 else (i if i < 60 else 100 + i % 3)) for i in range(80)] + [(8, i, i % 2) for i in range(3)]
    signatures = spark.createDataFrame([(i, bytes(rng.randrange(256) for _ in range(2 * minhash.PERMUTATIONS)) if i >= 60 else b"x" * (2 * minhash.PERMUTATIONS)) for i in range(80)], "node bigint, signature binary")
    dealt = minhash._refined(spark.createDataFrame(rows, "bucket bigint, node bigint, component bigint"), signatures, 10).select("bucket", "node", "component").collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault(r["bucket"], []).append((r["node"], r["component"]))
    met = {(a, b) for t in tasks.values() for a, x in t for b, y in t if x != y}
    alike = [(i, c) for b, i, c in rows if b == 7 and i < 60]  # the others have random signatures: no band parts these
    assert all((a, b) in met for a, x in alike for b, y in alike if x != y) and (0, 1) in met
    assert max(len(t) for t in tasks.values()) <= 40


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u bigint, v bigint")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_min_max_estimates_the_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    equal = (minhash.min_max(minhash.mixed(a)) == minhash.min_max(minhash.mixed(b))).mean()
    assert abs(equal - 800 / 1200) < 0.15


def test_exact_dedup_checks_full_contents_when_digests_clash(spark):
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id bigint, text string")
    weak = lambda content: F.lit("same").cast("string") if content is not None else content
    got = exact_dedup.exact_duplicates(docs, digest=weak).collect()
    assert {r["id"]: r["keep_id"] for r in got} == {i: i % 5 for i in range(40)} and {r["group_size"] for r in got} == {8}


@pytest.mark.parametrize("weak", [False, True])
def test_the_dedup_state_goes_on_from_feed_to_feed(spark, tmp_path, weak):
    """Three feeds, the state opened anew for each; with ``weak`` all digests clash and the contents that locators name decide."""
    digest = (lambda content: F.substring(exact_dedup.sha256(content), 1, 0)) if weak else exact_dedup.sha256
    feeds = [[(10, "a  b"), (11, "c"), (12, "a b"), (None, "z")], [(5, "a\tb"), (6, "d"), (11, "c")], [(20, "a b"), (21, "e"), (22, None), (23, "")]]
    seen = []
    for rows in feeds:
        got = exact_dedup.DedupState(spark, str(tmp_path / "state"), digest).feed(spark.createDataFrame(rows, "doc_id bigint, text string"))
        seen += [(i, re.sub("[\\x20\\x09-\\x0D]+", " ", t or "")) for i, t in rows]
        groups = {}
        for i, t in seen:
            groups.setdefault(t, []).append(i)
        want = [(i, min((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t in seen[-len(rows) :]]
        assert sorted(((r["id"], r["keep_id"], r["group_size"]) for r in got.collect()), key=str) == sorted(want, key=str)


def fed(spark, state, rows, feed_id=None):
    got = state.feed(spark.createDataFrame(rows, "doc_id bigint, text string"), feed_id=feed_id).collect()
    return sorted((r["id"], r["keep_id"], r["group_size"]) for r in got)


def one_digest(content):
    return F.substring(exact_dedup.sha256(content), 1, 0)


def test_contents_of_a_clash_in_an_earlier_feed_are_not_forgotten(spark, tmp_path):
    state = exact_dedup.DedupState(spark, str(tmp_path / "state"), one_digest)
    assert fed(spark, state, [(1, "A"), (5, "B")]) == [(1, 1, 1), (5, 5, 1)]
    assert fed(spark, state, [(7, "A")]) == [(7, 1, 2)]
    assert fed(spark, state, [(8, "B"), (2, "C")]) == [(2, 2, 1), (8, 5, 2)]
    assert fed(spark, exact_dedup.DedupState(spark, str(tmp_path / "state"), one_digest), [(0, "B")]) == [(0, 0, 3)]


@pytest.mark.parametrize(("step", "digest"), [("move", exact_dedup.sha256), ("_stream", exact_dedup.sha256), ("_record", exact_dedup.sha256), ("_verdicts", one_digest)])
def test_a_feed_that_died_is_taken_up_again(spark, tmp_path, monkeypatch, step, digest):
    """A failure before and after each step: the same feed again, or another one first, gives what one try would have given."""
    first, second, third = [(3, "a"), (4, "b"), (4, "b")], [(1, "a"), (9, "c")], [(2, "b"), (8, "c")]
    owner = exact_dedup if step == "move" else exact_dedup.DedupState
    right = getattr(owner, step)
    for k, after in enumerate((False, True)):
        root = str(tmp_path / f"state{k}")
        assert fed(spark, exact_dedup.DedupState(spark, root, digest), first, "first") == [(3, 3, 1), (4, 4, 2), (4, 4, 2)]

        def dies(*given):
            if after:
                right(*given)
            raise OSError("lost")

        monkeypatch.setattr(owner, step, dies)
        with pytest.raises(OSError, match="lost"):
            fed(spark, exact_dedup.DedupState(spark, root, digest), second, "second")
        monkeypatch.setattr(owner, step, right)
        if k:  # another feed comes in between: what is in the log by then counts before it
            there = step != "move" or after
            assert fed(spark, exact_dedup.DedupState(spark, root, digest), third, "third") == [(2, 2, 3), (8, 8, 2 if there else 1)]
        else:
            assert fed(spark, exact_dedup.DedupState(spark, root, digest), second, "second") == [(1, 1, 2), (9, 9, 1)]
            assert fed(spark, exact_dedup.DedupState(spark, root, digest), third, "third") == [(2, 2, 3), (8, 8, 2)]
        again = fed(spark, exact_dedup.DedupState(spark, root, digest), second, "second")
        assert again == [(1, 1, 2), (9, 9, 1)]
        assert fed(spark, exact_dedup.DedupState(spark, root, digest), [(7, "a")], "last") == [(7, 1, 3)]
    with pytest.raises(ValueError, match="identifier"):
        exact_dedup.DedupState(spark, root, digest).feed(spark.createDataFrame(first, "doc_id bigint, text string"), feed_id="a/b")


def test_a_feed_reads_only_what_locators_name(spark, tmp_path, monkeypatch):
    read, right = [], exact_dedup.DedupState._parts
    monkeypatch.setattr(exact_dedup.DedupState, "_parts", lambda self, names: read.append(names) or right(self, names))
    state = exact_dedup.DedupState(spark, str(tmp_path / "state"))
    for k, rows in enumerate(([(1, "a")], [(2, "b")], [(3, "c")], [(4, "d")])):
        fed(spark, state, rows, f"f{k}")
    assert not read
    assert fed(spark, state, [(5, "b"), (6, "e")], "f4") == [(5, 2, 2), (6, 6, 1)] and read == [["part=000000001-f1"]]


def test_decontamination_equals_a_scan(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60)))) for i in range(25)]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = items[i % 25][1].split()
        docs.append((i, " ".join(w)))
    planted = {(i, i % 25) for i in range(0, 120, 3)}
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for most in (20_000, 5):
        assert {(r["id"], r["item"]) for r in contaminated(d, b, broadcast_items=most).collect()} == planted


def test_every_fingerprint_within_the_radius_is_a_candidate():
    text = " ".join(f"x{i}" for i in range(30))
    index = Index([(1, text)], 3)
    (size, (prints, *_)) = next(iter(index.tables.items()))
    for flips in ((), (0,), (0, 17, 40), (5, 6, 7)):
        changed = prints[0]
        for f in flips:
            changed ^= np.uint64(1) << np.uint64(f)
        hits = [any(known[np.searchsorted(known, v) : np.searchsorted(known, v, "right")].size for v in values) for (_, values), (known, *_) in zip(__import__("tessera.llm.decontamination", fromlist=["blocks"]).blocks(np.array([changed]), 3), index.tables[size][3], strict=True)]
        assert any(hits)
    assert weighted_similarity(text_words("a b a", ALNUM), text_words("a b", ALNUM)) == pytest.approx(2 / 3)


def own_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def license_by_scan(text, score):
    """Words, places and labels of phrases, and labels and the greatest containment of templates, by plain scans."""
    words = own_words(text)
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    places = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    lines = text.split("\n")
    paragraphs, current = [], []
    for line in lines:
        if own_words(line):
            current += own_words(line)
        else:
            paragraphs, current = [*paragraphs, current], []
    found = {}
    for block in [*map(own_words, lines), *paragraphs, current]:
        for label, texts in license_scan.TEMPLATES.items():
            for t in map(set, map(own_words, texts)):
                if len(t & set(block)) >= license_scan.THRESHOLD * len(t) - 1e-9:
                    found[label] = max(found.get(label, 0), len(t & set(block)) / len(t))
    at = [i for i, _ in places]
    base = {label for _, label in places}
    row = (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())))
    return (*row, 1.0 if base else max(found.values(), default=0.0)) if score else row


def test_licenses_equal_a_scan(spark, sf):
    got = {r["doc_id"]: r for r in queries()["op5_license_scan"](spark, sf).collect()}
    for doc, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        assert tuple(got[doc])[1:7] == license_by_scan(text, False)[:6] and got[doc]["score"] == pytest.approx(license_by_scan(text, True)[-1])


def test_license_texts_are_found_in_blocks_of_any_length(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    rows = []
    for label, texts in license_scan.TEMPLATES.items():
        for t in texts:
            w = t.split()
            for drop in (0, len(w) // 10, len(w) // 4):
                cut = sorted(rng.sample(range(len(w)), len(w) - drop))
                rows += [(len(rows), f"{filler(300)} {' '.join(w[i] for i in cut)} {filler(400)}\n{filler(20)}"), (len(rows) + 1, f"{filler(9)}\n\n" + " ".join(w[i] + ("\n" if i % 7 == 6 else "") for i in cut) + f"\n\n{filler(9)}")]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "the Apache, LICENSE; mit\nlicense général public License")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for doc, text in rows:
        want = license_by_scan(text or "", True)
        assert tuple(got[doc])[1:7] == want[:6] and got[doc]["score"] == pytest.approx(want[6])


def test_kth_largest(spark):
    rows = spark.createDataFrame([(float(x % 50) / 3,) for x in range(400)], "x double")
    values = sorted((r[0] for r in rows.collect()), reverse=True)
    for k in (1, 7, 8, 9, 200, 400):
        assert quality.kth_largest(rows, "x", k, bins=8) == values[k - 1]


def test_quality_keeps_good_and_rejects_bad_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_verdicts(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), F.col("id") == F.col("doc_id"))
    good, bad = got.filter("quality = 1"), got.filter("quality = 0")
    assert good.filter("not kept").count() <= 0.01 * good.count() and bad.filter("kept").count() <= 0.05 * bad.count()


def test_quality_weights_and_draw_equal_a_direct_count(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text", "here"] if i % 3 else ["%%", "!!", "here"]) for _ in range(rng.randint(0, 30)))) for i in range(90)] + [(90, None), (91, "here here here")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 60)] + [(3, 0, 0), (4, 1, 0)]
    got = {r["id"]: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), k=40).collect()}

    def grams(text):  # as a list of their names
        w = (text or "").split()
        w = ["<again>" if k and w[k] == w[k - 1] else w[k] for k in range(len(w))] if w else []
        padded = f" {text} "
        return w + [" ".join(p) for p in zip(w, w[1:])] + ([f"3:{padded[k : k + 3]}" for k in range(len(padded) - 2)] if w else [])

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i < 60 and i % 3:
            target.update(grams(t))
    assert len({int(b) for i, t in rows for b in quality.ngrams(t)}) == len(raw)  # no two of them share a bucket
    share = lambda c, g: (c[g] + 0.5) / (c.total() + 0.5 * quality.BUCKETS)
    for i, t in rows:
        g = grams(t)
        want = sum(np.log(share(target, x) / share(raw, x)) for x in g) * min(1, 200 / len(g)) if g else quality.LEAST
        assert got[i]["log_weight"] == pytest.approx(want, abs=1e-9)
    drawn = sorted((r["key"] for r in got.values()), reverse=True)[:40]
    assert {i for i, r in got.items() if r["kept"]} == {i for i, r in got.items() if r["key"] in drawn}


def test_best_cut():
    assert quality.best_cut(np.array([1.0, 2, 3]), np.array([-3.0, -2, 1.5])) in (-0.5, 1.25, 1.75)
    assert quality.best_cut(np.array([5.0]), np.array([1.0])) == 3.0


def test_manifest_versions_and_conflicts(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"), fanout=2)
    first = store.append(spark.range(10).withColumnRenamed("id", "doc_id"))
    store.append(spark.range(10, 20).withColumnRenamed("id", "doc_id"))
    with pytest.raises(compaction.Conflict):
        store.commit(first, [])
    assert store.read(1).count() == 10
    store.compact()
    assert store.read().count() == 20 and len(store.manifest()["runs"]) == 1 and store.read(2).count() == 20
    assert store.manifest()["runs"][0].rows == 20
    store.vacuum(keep=1)
    assert store.versions() == [3] and store.read().count() == 20


@pytest.mark.parametrize("rival", ["append", "compact"])
def test_of_two_writers_from_one_base_none_loses_rows(spark, tmp_path, rival):
    """While one store writes its run, another commits; both changes hold."""

    class Interrupted(compaction.ShardStore):
        pending = None

        def commit(self, base, runs):
            act, self.pending = self.pending, None
            if act:
                act()
            return super().commit(base, runs)

    at, ids = str(tmp_path / "s"), lambda lo, hi: spark.range(lo, hi).withColumnRenamed("id", "doc_id")
    one, two = Interrupted(spark, at, fanout=2), compaction.ShardStore(spark, at, fanout=2)
    one.append(ids(0, 5)), one.append(ids(5, 10))
    if rival == "append":
        one.pending = lambda: two.append(ids(10, 15))
        one.append(ids(15, 20))
        assert sorted(r[0] for r in two.read().select("doc_id").collect()) == list(range(20)) and len(two.manifest()["runs"]) == 4
    else:
        one.pending = two.compact
        one.compact()
        assert sorted(r[0] for r in two.read().select("doc_id").collect()) == list(range(10)) and len(two.manifest()["runs"]) == 1
    names = {x.name for x in two.manifest()["runs"]} | {x.name for v in two.versions() for x in two.manifest(v)["runs"]}
    assert {p.name for p in (tmp_path / "s" / "runs").iterdir() if p.is_dir()} == names


def test_a_column_named_shard_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        compaction.ShardStore(spark, str(tmp_path / "s")).append(spark.range(1).withColumnRenamed("id", "__SHARD"))


def test_op7_against_a_recount(spark, sf):
    rows = queries()["op7_sharding"](spark, sf).collect()
    docs = {r["doc_id"]: len((r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(docs) and {r["doc_id"]: r["n_bytes"] for r in rows} == docs
    assert len({r["version"] for r in rows}) == 1 and rows[0]["version"] == 5  # four appends, one merge of four runs
    assert {r["tier"] for r in rows} == {1} and all(r["shard"].endswith(".parquet") for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    assert_same(spark, connection(sf), queries()[name], oracle_sql()[name], sf)


def test_pipeline(spark, sf):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf).collect()
    assert len({r["doc_id"] for r in got}) > 100 and len(corpus_pipeline.STAGES) == 5


def test_digests_of_op1(spark, sf):
    rows = {r["doc_id"]: r for r in queries()["op1_pii"](spark, sf).collect()}
    for doc, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        base = base_by_patterns(text)
        assert rows[doc]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [rows[doc][f"n_{x}"] for x in pii.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
