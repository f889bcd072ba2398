"""Documents with every odd case, and references by brute force."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "the quick brown fox jumps over the lazy dog while seven grey cats watch from an old stone wall near the river bank"
#: doc_id, text, lang, source, and columns whose names the operators also use.
ODD = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE + " and then they all went home", None, "a"),
    (4, "", "en", None),
    (5, None, "en", "a"),
    (None, PROSE, "en", "a"),
    (None, None, None, None),
    (6, "one two", "en", "b"),
    (7, "One  TWO", "de", "b"),
    (8, " \t\n ", "en", "b"),
    (9, "x" * 70_000, "en", "b"),
    (10, "word " * 20_000, "en", "b"),
    (11, "émile öäü 中文 😀 <|endoftext|> it's 12'345", "fr", "b"),
    (12, "mail bob@example.com or +1 (555) 123-4567 from 10.0.0.1, card 4539578763621486", "en", "b"),
    (12, "another text under the same number", "en", "b"),
    (13, "Released under the MIT License.\nMIT license", "en", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest int, content string, length int, key double, path string, bucket int, node int, kept boolean, __rank int"


def odd(spark):
    return spark.createDataFrame([(*r, 0, "x", 1, "c", 2, 0.5, "p", 3, 4, True, 9) for r in ODD], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """(doc_id, text) without nulls and repeated numbers: the smallest number linked with each."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
