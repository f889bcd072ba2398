"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (e-mail addresses, IP addresses, card and phone numbers); they always stay. The field labels
the tokens of a document that carry digits or an at sign: it adds mentions that no pattern matches but whose context and
whose distant twins say what they are (a phone number that is later given without its country code, the part of an
address before the at sign). Neighbouring tokens are linked in a chain. Tokens with the same digits, the same spelling or
an address with its local part are linked through one hub for each such key, however many they are, so the graph grows
with the document; loopy message passing runs over both kinds of links. The potentials are learned piecewise from the
base spans of a bounded sample of documents, with and without such spans: token features by multinomial logistic regression, links by how often labels
meet along them.

Null and empty texts have no spans. Rows given twice are searched twice. If the sample has no spans, only base spans are
returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
#: Documents with tokens of the field.
LIKELY = re.compile(r"[0-9@]")
#: Matches begin with a run of digits; runs are never given back, as what follows is no digit.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
STRIP = ",.;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    values = [int(x) for x in digits[::-1]]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, 0, found.end()
            used = found.end()
        else:
            used = max(used, at + 1)
        at = text.find("@", used)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap within the kind, by start, then kind."""
    out = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x[-9:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = only_digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: The field adds no shorter spans: a country code alone is nobody's.
LEAST_LENGTH = 4

# The field. Label 0 is no personal data; label k + 1 is KINDS[k].
LABELS = len(KINDS) + 1
CUES = {"email": ("mail", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "pay"), "phone": ("tel", "phone", "call", "fax", "mobile")}


#: Yes-or-no features of a token.
FEATURES = 27


class Tokens(NamedTuple):
    spans: list[tuple[int, int]]
    features: np.ndarray
    chain: np.ndarray  # pairs of token numbers
    skips: np.ndarray  # pairs of token number, hub number
    hubs: int


def tokens(text: str, locals_: set[str]) -> Tokens:
    """The tokens that carry a digit or an at sign, or equal the local part of an address, with their links."""
    words = list(TOKEN.finditer(text))
    spans, rows, chain, keys = [], [], [], []
    last = -9
    for i, m in enumerate(words):
        raw = m.group()
        core = raw.strip(STRIP)
        if not core or not (DIGIT.search(core) or "@" in core or core in locals_):
            continue
        digits, before = only_digits(core), words[i - 1].group().lower() if i else ""
        after = words[i + 1].group() if i + 1 < len(words) else ""
        parts = core.split(".")
        rows.append(
            [
                1.0,
                "@" in core,
                core in locals_,
                "." in core.partition("@")[2],
                raw.startswith("+"),
                raw.startswith("("),
                "-" in core,
                "=" in core,
                any(c.isalpha() for c in core) and "@" not in core,
                len(parts) == 4 and all(x.isdigit() for x in parts),
                len(parts) == 4 and all(x.isdigit() and len(x) < 4 and int(x) < 256 for x in parts),
                *(lo <= len(digits) < hi for lo, hi in ((1, 2), (2, 4), (4, 7), (7, 9), (9, 12), (12, 20), (20, 1 << 30))),
                12 <= len(digits) <= 19 and luhn(digits),
                before.startswith("+"),
                after.startswith("("),
                bool(DIGIT.search(before)),
                bool(DIGIT.search(after)),
                *(any(c in before for c in cues) for cues in CUES.values()),
            ]
        )
        k = len(spans)
        start = m.start() + raw.index(core)
        if raw.startswith("("):  # brackets around an area code belong to the number
            start = m.start()
        spans.append((start, start + len(core) + (raw[start - m.start() + len(core) :].startswith(")") and "(" in raw)))
        if i == last + 1:
            chain.append((k - 1, k))
        last = i
        mine = {core.lower()} | ({digits} if len(digits) >= 3 else set()) | ({core.partition("@")[0].lower()} if "@" in core else set())
        keys += [(key, k) for key in mine]
    number: dict[str, list[int]] = {}
    for key, k in keys:
        number.setdefault(key, []).append(k)
    shared = [v for v in number.values() if len(v) > 1]
    skips = [(k, h) for h, v in enumerate(shared) for k in v]
    return Tokens(spans, np.array(rows, float).reshape(-1, FEATURES), np.array(chain, int).reshape(-1, 2), np.array(skips, int).reshape(-1, 2), len(shared))


def token_labels(spans: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """The label of each token by the base spans that it overlaps; a longer kind's span wins over a shorter one's."""
    out = np.zeros(len(spans), int)
    best = np.zeros(len(spans), int)
    starts = np.array([s for s, _ in spans])
    ends = np.array([e for _, e in spans])
    for s, k, e in base:
        lo, hi = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        for i in range(lo, hi):
            if e - s > best[i]:
                out[i], best[i] = k + 1, e - s
    return out


class FieldModel(NamedTuple):
    weights: np.ndarray | None
    chain: np.ndarray  # log potentials of neighbours
    skip: np.ndarray  # log potentials of a token and its hub

    def marginals(self, t: Tokens, known: np.ndarray, rounds: int = 6) -> np.ndarray:
        """Label probabilities by loopy message passing; tokens of base spans keep their label."""
        n = len(t.spans)
        unary = np.zeros((n + t.hubs, LABELS))
        unary[:n] = t.features @ self.weights
        held = np.flatnonzero(known)
        unary[held] = -20.0
        unary[held, known[held]] = 20.0
        skips = t.skips + np.array([0, n])
        a, b = (np.concatenate([t.chain[:, k], t.chain[:, 1 - k], skips[:, k], skips[:, 1 - k]]) for k in (0, 1))
        m, s = len(t.chain), len(skips)
        table = np.concatenate([np.broadcast_to(x, (y, LABELS, LABELS)) for x, y in ((self.chain, m), (self.chain.T, m), (self.skip, s), (self.skip.T, s))])
        back = np.concatenate([np.arange(m) + m, np.arange(m), np.arange(s) + 2 * m + s, np.arange(s) + 2 * m])
        messages = np.zeros((len(a), LABELS))
        for _ in range(rounds if len(a) else 0):
            belief = unary.copy()
            np.add.at(belief, b, messages)
            x = (belief[a] - messages[back])[:, :, None] + table
            top = x.max(1, keepdims=True)
            new = np.log(np.exp(x - top).sum(1)) + top[:, 0]
            messages = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
        belief = unary
        np.add.at(belief, b, messages)
        e = np.exp(belief - belief.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True))[:n]

    def added(self, text: str, base: list[Span], sure: float = 0.9) -> list[Span]:
        """Spans of tokens that the field is sure of and no base span overlaps; neighbours of one kind become one span."""
        if self.weights is None or not LIKELY.search(text):
            return []
        t = tokens(text, {text[s:e].partition("@")[0] for s, k, e in base if k == 0})
        known = token_labels(t.spans, base)
        if known.all():  # also if there are none
            return []
        p = self.marginals(t, known)
        label = np.where(p.max(1) >= sure, p.argmax(1), 0)
        linked = {tuple(x) for x in t.chain.tolist()}
        out: list[Span] = []
        for i in np.flatnonzero((label > 0) & (known == 0)).tolist():
            start, end = t.spans[i]
            if out and out[-1][1] == label[i] - 1 and (i - 1, i) in linked and label[i - 1] == label[i] and not known[i - 1]:
                start = out.pop()[0]
            out.append((start, int(label[i]) - 1, end))
        return [x for x in out if x[2] - x[0] >= LEAST_LENGTH]


def _documents(texts: Iterator[str | None]) -> Iterator[tuple[str, list[Span]]]:
    for text in texts:
        if text and LIKELY.search(text):
            yield text, base_spans(text)


def train(texts: DataFrame, sample_rows: int = 4000) -> FieldModel:
    """Learn from about ``sample_rows`` of the documents (id, text) with a digit or an at sign, drawn by a hash of the identifier.

    Those without base spans are examples of tokens that are no personal data.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # features are yes or no, so tokens are counted by the bits of their features and their label
        seen: Counter[tuple[int, int]] = Counter()
        near, twins = np.zeros((LABELS, LABELS), np.int64), np.zeros((LABELS, LABELS), np.int64)
        for batch in batches:
            for text, base in _documents(batch.column(0).to_pylist()):
                t = tokens(text, {text[s:e].partition("@")[0] for s, k, e in base if k == 0})
                known = token_labels(t.spans, base)
                if len(known):
                    bits = (t.features.astype(np.int64) << np.arange(t.features.shape[1])).sum(1)
                    seen.update(zip(bits.tolist(), known.tolist(), strict=True))
                np.add.at(near, (known[t.chain[:, 0]], known[t.chain[:, 1]]), 1)
                counts = np.zeros((t.hubs, LABELS), np.int64)
                np.add.at(counts, (t.skips[:, 1], known[t.skips[:, 0]]), 1)
                twins += counts.T @ counts - np.diag(counts.sum(0))
        links = [(kind, i, int(x)) for kind, m in (("near", near), ("twins", twins)) for i, x in enumerate(m.ravel()) if x]
        rows = [("token", bits, label, n) for (bits, label), n in seen.items()] + [(kind, i, 0, n) for kind, i, n in links]
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["what", "key", "label", "n"])

    # only these have tokens: cheap to see before anything is drawn
    likely = texts.filter(F.col("text").rlike(LIKELY.pattern))
    n = likely.count()
    drawn = likely.filter(F.pmod(F.xxhash64("id", F.lit("pii sample")), F.lit(1_000_003)) < min(1.0, sample_rows / max(1, n)) * 1_000_003)
    counted = drawn.select("text").mapInArrow(examples, "what string, key bigint, label int, n bigint").groupBy("what", "key", "label").agg(F.sum("n").alias("n"))
    # a row for each pattern of features that occurs, however many tokens there are
    found = sorted((r["what"], r["key"], r["label"], r["n"]) for r in counted.collect())
    patterns = [r for r in found if r[0] == "token"]
    none = np.zeros((LABELS, LABELS))
    if not any(label for _, _, label, _ in patterns):
        return FieldModel(None, none, none)
    features = (np.array([r[1] for r in patterns])[:, None] >> np.arange(FEATURES) & 1).astype(float)
    labels, times = np.array([r[2] for r in patterns]), np.array([r[3] for r in patterns], float)
    near, twins = none.copy(), none.copy()
    for what, key, _, n in found:
        if what != "token":
            (near if what == "near" else twins).ravel()[key] = n

    def affinity(counts: np.ndarray) -> np.ndarray:
        """How much more often labels meet than by chance, in logs."""
        p = (counts + counts.T + 0.5) / (2 * counts.sum() + 0.5 * LABELS**2)
        return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -3, 3)

    # logistic regression by gradient steps of Newton size for the shared bound of the curvature
    target = np.eye(LABELS)[labels]
    weights = np.zeros((features.shape[1], LABELS))
    share = (times / times.sum())[:, None]
    bound = np.linalg.inv(0.5 * features.T @ (share * features) + 1e-3 * np.eye(FEATURES))
    for _ in range(200):
        z = features @ weights
        e = np.exp(z - z.max(1, keepdims=True))
        weights += bound @ (features.T @ (share * (target - e / e.sum(1, keepdims=True))) - 1e-3 * weights)
    return FieldModel(weights, affinity(near), affinity(twins))


SEARCHED = "id bigint, base array<struct<start: bigint, kind: int, end: bigint>>, spans array<struct<start: bigint, kind: int, end: bigint>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> DataFrame:
    """One row per input row: id, base spans and all spans (start, number of the kind in KINDS, end; code points, end exclusive)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = train(rows, sample_rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        row = lambda spans: [{"start": s, "kind": k, "end": e} for s, k, e in spans]
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else []
                base.append(row(found))
                spans.append(row(sorted(found + model.added(text, found))) if text else [])
            yield pa.record_batch([batch.column(0), pa.array(base, kind), pa.array(spans, kind)], names=["id", "base", "spans"])

    return rows.select("id", "text").mapInArrow(search, SEARCHED)
