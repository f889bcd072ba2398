"""Near-duplicate components by min-max hashing.

Each of 64 permutations gives a document both the least and the greatest of its hashed shingles: 128 values from 64
evaluations, in 32 bands of 4 values of different permutations (mins and maxes apart). A pair at the threshold of 0.75
shares no band with probability 6e-6.

1. Texts with the same shingle set form a class; one document stands for it.
2. Star and ring round: in each band bucket every class is compared by signature with the bucket's first and last (star)
   and with its neighbours in an order by hash (ring). Its best candidate among the former and its two best among the
   latter are confirmed on the full sets, and components are formed.
3. Cross round: in each bucket that still holds several components, all pairs from different ones are compared by
   signature. For each text and larger component with a member within four standard deviations of the threshold, the full
   sets of the text and of the best such member decide; where they do not link, the text goes to the blocks of the
   component that hold such members, and all of those are tried. Only links leave a task.
   Buckets of more than ``bucket_rows`` rows are dealt out. If half of that is enough for the rows outside the bucket's largest
   component, these go to blocks of its rows. Else rows are first dealt out by 24 further bands of three values within the bucket (a
   pair at the threshold shares none with probability 2e-6), twice at most; what is large still is cut in tiles, and each pair of tiles is one task's.

Null or empty texts have an empty set and link with nothing. Rows given twice are one class. An identifier that is on
several texts is one document, linked by any of them. Rows without identifier link with nothing; their component is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import top_n_per_group
from .components import components
from .shared import filtered, joined_by_weight, new_path, slices, temporary, written, written_at
from .words import U, mixed, shingle_set, stream

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
MULTIPLIERS, ADDENDS = stream(21, PERMUTATIONS) | U(1), stream(22, PERMUTATIONS)
BAND_SEEDS = stream(23, BANDS)
VALUE_WEIGHTS = stream(24, ROWS) | U(1)
#: Of 128 values, so many must agree for a pair to be confirmed: 0.6 of them, four standard deviations under 0.75.
LEAST_AGREEING = 77
SKETCH = "id bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary"


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The least and the greatest of the shingles under each permutation: mins, then maxes."""
    low, high = np.full(PERMUTATIONS, U(0xFFFFFFFFFFFFFFFF)), np.zeros(PERMUTATIONS, U)
    for at in range(0, len(shingles), 4096):
        h = shingles[at : at + 4096, None] * MULTIPLIERS + ADDENDS
        h ^= h >> U(32)
        h *= U(0x9E3779B97F4A7C15)
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    return mixed((mixed(values).reshape(BANDS, ROWS) * VALUE_WEIGHTS).sum(1) + BAND_SEEDS).view(np.int64)


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` (id, text): the set's size and key, band keys, and one byte of each signature value."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, size)
                values = min_max(found) if len(found) else None
                out[0].append(len(found))
                out[1].append(blake2b(found.tobytes(), digest_size=16).digest())
                out[2].append(band_keys(values) if len(found) else [])
                out[3].append((mixed(values) >> U(56)).astype(np.uint8).tobytes() if len(found) else b"")
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.record_batch([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["id", "n_shingles", "set_key", "bands", "signature"])

    return docs.select("id", "text").mapInArrow(sketch, SKETCH)


def _agreeing(pairs: DataFrame) -> DataFrame:
    """(a, b) with agreeing: how many values of the signatures sig_a and sig_b are equal; those under the bound go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for i in (2, 3))
            equal = (left == right).sum(1)
            keep = equal >= LEAST_AGREEING
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(equal[keep].astype(np.int64))], names=["a", "b", "agreeing"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(count, "a bigint, b bigint, agreeing bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full shingle sets reach the similarity. texts: (id, text).

    A pair is confirmed where its first document's text is; documents in many pairs are dealt out in groups of pairs.
    """
    per_first = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / 64).alias("parts"))
    keyed = pairs.join(per_first, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    second = keyed.join(texts, keyed["b"] == texts["id"]).select("a", "part", "b", "text")
    used = keyed.select("a", "part").distinct()
    first = used.join(texts, used["a"] == texts["id"]).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = first.unionByName(second).repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, part, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = shingle_set(text, size)
                if b is None:
                    if (a, part) != at:
                        at, sets = (a, part), []
                    sets.append(own)
                    continue
                for other in sets:
                    if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                        continue
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found[0].append(a)
                        found[1].append(b)
                        break
            yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    return rows.mapInArrow(confirm, "u bigint, v bigint")


CROSSING = "node bigint, other bigint, block bigint, member bigint, agreeing bigint"


def _crossing(rows: DataFrame) -> DataFrame:
    """(node, other, block): a text, a larger component, and a block of it with a member near the text; the best such member.

    rows: bucket, node, component, members, block, size, signature.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ("node", "component", "members", "block", "size")
    dealt = rows.select("bucket", *columns, "signature").repartition(parts, "bucket").sortWithinPartitions("bucket")

    def compare(node: np.ndarray, component: np.ndarray, members: np.ndarray, block: np.ndarray, size: np.ndarray, signature: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        names, counts = np.unique(component, return_counts=True)
        if len(names) < 2:
            return
        # the bucket's largest component is only compared with the rest
        for i in np.flatnonzero(component != names[counts.argmax()]):
            js = np.flatnonzero((component != component[i]) & (4 * np.minimum(size, size[i]) >= 3 * np.maximum(size, size[i])))
            agreeing = (signature[js] == signature[i]).sum(1)
            js, agreeing = js[agreeing >= LEAST_AGREEING], agreeing[agreeing >= LEAST_AGREEING]
            larger = (members[js] > members[i]) | (members[js] == members[i]) & (component[js] < component[i])
            up, down = js[larger], js[~larger]
            yield np.full(len(up), node[i]), component[up], block[up], node[up], agreeing[larger]
            yield node[down], np.full(len(down), component[i]), np.full(len(down), block[i]), np.full(len(down), node[i]), agreeing[~larger]

    def best(made: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Of each (node, other, block) the member that agrees most."""
        all_ = [np.concatenate([x[k] for x in made]) for k in range(5)]
        order = np.lexsort((all_[3], -all_[4], all_[2], all_[1], all_[0]))
        node, other, block, member, agreeing = (x[order] for x in all_)
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1]) | (block[1:] != block[:-1])
        return pa.record_batch([pa.array(x[new].astype(np.int64)) for x in (node, other, block, member, agreeing)], names=["node", "other", "block", "member", "agreeing"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            bucket = table.column("bucket").to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            if not last:  # the last bucket may go on in the next batch
                held.extend(table.slice(bounds[-2]).to_batches())
                bounds = bounds[:-1]
            arrays = [table.column(c).to_numpy() for c in columns]
            arrays.append(np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS))
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                made = [p for p in compare(*(c[lo:hi] for c in arrays)) if len(p[0])]
                if made:
                    yield best(made)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from groups(False)
        if held:
            yield from groups(True)

    found = dealt.mapInArrow(pairs, CROSSING)
    return found.groupBy("node", "other", "block").agg(F.max_by(F.struct("member", "agreeing"), F.struct("agreeing", "member")).alias("m")).select("node", "other", "block", "m.*")


def _links_across(asked: DataFrame, placed: DataFrame, texts: DataFrame, size: int, percent: int, group: int = 256) -> DataFrame:
    """For each (node, other, block) of ``asked`` a link (u, v) with a member of the component in that block, if there is one.

    placed: node, component, block, signature of all candidates. A task takes one block of a component (some 256 members) and at most
    about ``group`` of the texts that are compared with it.
    """
    per_block = asked.groupBy("other", "block").agg(F.count(F.lit(1)).alias("n")).select(F.col("other").alias("component"), "block", F.ceil(F.col("n") / group).alias("parts"))
    inside = placed.join(per_block, ["component", "block"]).select("component", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "node", "signature", F.lit(0).alias("kind"))
    outside = asked.select(F.col("other").alias("component"), "block", "node").join(per_block, ["component", "block"])
    outside = outside.join(placed.select("node", "signature"), "node").select("component", "block", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", "signature", F.lit(1).alias("kind"))
    both = inside.unionByName(outside).join(texts.select(F.col("id").alias("node"), "text"), "node")
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ("component", "block", "part")
    rows = both.select(*place, "kind", "node", "signature", "text").repartition(parts, *place).sortWithinPartitions(*place, "kind")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, sets, matrix = None, [], {}, np.zeros((0, 2 * PERMUTATIONS), np.uint8)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for component, block, part, kind, node, signature, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (component, block, part) != at:
                    at, members, sets, matrix = (component, block, part), [], {}, None
                if kind == 0:
                    members.append((node, signature, text))
                    continue
                if matrix is None:
                    matrix = np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(-1, 2 * PERMUTATIONS)
                agreeing = (matrix == np.frombuffer(signature, np.uint8)).sum(1)
                own = None
                for k in sorted(np.flatnonzero(agreeing >= LEAST_AGREEING), key=lambda k: -agreeing[k]):
                    own = shingle_set(text, size) if own is None else own
                    if k not in sets:
                        sets[k] = shingle_set(members[k][2], size)
                    other = sets[k]
                    if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                        continue
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * shared >= percent * (len(own) + len(other) - shared):
                        found[0].append(node)
                        found[1].append(members[k][0])
                        break  # the component needs no second link to this node
            yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    return rows.mapInArrow(confirm, "u bigint, v bigint")


def _across(crossing: DataFrame, placed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) of texts with larger components: by the best member, else by any that is near."""
    best = crossing.groupBy("node", "other").agg(F.max_by("member", F.struct("agreeing", "member")).alias("member"))
    best = written(best, "best-members")
    links = written(_confirmed(best.select(F.col("member").alias("a"), F.col("node").alias("b")), texts, size, percent), "links")
    left = best.join(links.select(F.col("u").alias("member"), F.col("v").alias("node")), ["member", "node"], "left_anti")
    asked = written(crossing.join(left, ["node", "other"], "left_semi").select("node", "other", "block"), "asked-blocks")
    return links if asked.isEmpty() else links.unionByName(_links_across(asked, placed, texts, size, percent))


def _mixed_buckets(rows: DataFrame) -> DataFrame:
    """Of buckets with several components: rows, the largest component, and its rows (``most``)."""
    per = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    found = per.groupBy("bucket").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"))
    return written(found.filter("components > 1").drop("components"), "mixed-buckets")


def _refined(rows: DataFrame, signatures: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows of buckets with several components, with their signatures; buckets of more than ``bucket_rows`` rows are dealt out."""
    half = max(1, bucket_rows // 2)
    scattered = (F.col("rows") > bucket_rows) & (F.col("rows") - F.col("most") > half)
    mixed_rows = written(rows.join(_mixed_buckets(rows), "bucket"), "mixed-rows")
    ready = [mixed_rows.filter(~scattered)]
    for level in (1, 2):
        wide = mixed_rows.filter(scattered).drop("rows", "largest", "most")
        if wide.isEmpty():
            break
        band = F.explode(F.array(*[F.xxhash64("bucket", F.lit(j), F.expr(f"substring(signature, {5 * j + level}, 3)")) for j in range(24)]))
        dealt = written(wide.join(signatures, "node").withColumn("bucket", band).drop("signature"), "dealt-rows")
        mixed_rows = written(dealt.join(_mixed_buckets(dealt), "bucket"), "mixed-rows")
        ready.append(mixed_rows.filter(~scattered))
    mixed_rows = reduce(DataFrame.unionByName, [*ready, mixed_rows.filter(scattered)])
    # Tiles 0 to strays - 1 are of rows outside the largest component, the others of its rows: no two of these are compared.
    strays, bigs = F.ceil((F.col("rows") - F.col("most")) / half), F.ceil(F.col("most") / half)
    own = F.xxhash64("node", F.lit("tile"))
    large = mixed_rows.filter(F.col("rows") > bucket_rows).withColumns({"strays": strays, "bigs": bigs})
    large = large.withColumn("tile", F.when(F.col("component") == F.col("largest"), F.col("strays") + F.pmod(own, F.col("bigs"))).otherwise(F.pmod(own, F.col("strays"))))
    with_strays = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("tile"), F.col("strays") - 1)), lambda i: F.struct(i.alias("i"), F.col("tile").alias("j")))
    after = F.transform(F.sequence(F.col("tile"), F.col("strays") + F.col("bigs") - 1), lambda j: F.struct(F.col("tile").alias("i"), j.alias("j")))
    pairs = F.when(F.col("tile") < F.col("strays"), F.array_distinct(F.concat(with_strays, after))).otherwise(with_strays)
    large = large.withColumn("pair", F.explode(pairs)).withColumn("bucket", F.xxhash64("bucket", "pair.i", "pair.j")).drop("strays", "bigs", "tile", "pair")
    return mixed_rows.filter(F.col("rows") <= bucket_rows).unionByName(large).join(signatures, "node")


def _signed(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    left, right = (signatures.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}")) for x in "ab")
    return _agreeing(pairs.join(left, "a").join(right, "b"))


def _first_pairs(members: DataFrame, signatures: DataFrame, bucket_rows: int) -> DataFrame:
    """Distinct pairs (a, b) of the star and ring round. members: bucket, node, size, and the bucket's rows, low and high (node, size)."""
    alike = lambda x, y: 4 * F.least(x, y) >= 3 * F.greatest(x, y)
    star = members.select("node", "size", F.explode(F.array("low", "high")).alias("hub")).filter((F.col("node") != F.col("hub.node")) & alike(F.col("size"), F.col("hub.size")))
    star = _signed(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), signatures)
    to_hub = star.groupBy("b").agg(F.max_by("a", F.struct("agreeing", "a")).alias("a")).select("a", "b")
    place = F.xxhash64("node", "bucket")
    around = Window.partitionBy("bucket", F.pmod(place, F.ceil(F.col("rows") / bucket_rows))).orderBy(place, "node")
    ring = members.select("node", "size", F.lead(F.struct("node", "size")).over(around).alias("next")).filter(alike(F.col("size"), F.col("next.size")) & (F.col("node") != F.col("next.node")))
    ring = _signed(ring.select(F.least("node", "next.node").alias("a"), F.greatest("node", "next.node").alias("b")).distinct(), signatures)
    ends = ring.select("a", "b", "agreeing", F.explode(F.array("a", "b")).alias("end"))
    to_neighbours = top_n_per_group(ends, ["end"], [F.col("agreeing").desc(), F.col("a"), F.col("b")], 2).select("a", "b")
    both = to_hub.unionByName(to_neighbours).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bucket_rows: int = 1024) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest identifier linked, itself included), kept."""
    with temporary(docs.sparkSession) as keep:
        return written_at(_near_duplicates(docs, id_col, text_col, size, percent, bucket_rows), keep(new_path(docs.sparkSession, "near-duplicates")))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, bucket_rows: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = written(sketches(rows, size), "sketches")
    sets = sketched.filter("n_shingles > 0 and id is not null")
    classes = written(
        sets.groupBy("set_key").agg(F.min_by(F.struct("id", F.col("n_shingles").alias("size"), "bands", "signature"), "id").alias("r")).select("set_key", F.col("r.id").alias("node"), "r.size", "r.bands", "r.signature"),
        "classes",
    )
    signatures = classes.select("node", "signature")
    in_bands = classes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("node", "size")).alias("low"), F.max(F.struct("node", "size")).alias("high")).filter("low.node <> high.node")
    members = written(in_bands.join(buckets, "bucket"), "bucket-members")  # of buckets with at least two classes
    texts = written(rows.join(members.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "candidate-texts")
    # Star and ring round.
    first = written(_first_pairs(members, signatures, bucket_rows), "first-pairs")
    same_id = sets.join(classes.select("set_key", "node"), "set_key").groupBy("id").agg(F.collect_set("node").alias("nodes")).filter("size(nodes) > 1")
    same_id = same_id.select(F.array_min("nodes").alias("u"), F.explode("nodes").alias("v")).filter("u <> v")
    links = written(_confirmed(first, texts, size, percent).unionByName(same_id), "links")
    found = written(components(links), "components")
    # Cross round.
    component = F.coalesce("component", "node").alias("component")
    placed = signatures.join(members.select("node").distinct(), "node", "left_semi").join(found, "node", "left").select("node", "signature", component)
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = written(joined_by_weight(placed, sizes, "component", "members").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / 256))), "placed")
    marked = members.select("bucket", "node", "size").join(placed.select("node", "component", "members", "block"), "node")
    crossing = written(_crossing(_refined(marked, signatures, bucket_rows)), "crossing")
    if not crossing.isEmpty():
        more = written(_across(crossing, placed, texts, size, percent), "links")
        if not more.isEmpty():
            found = written(components(links.unionByName(more)), "components")
    of_class = classes.select("set_key", "node").join(found, "node", "left").select("set_key", component)
    out = sketched.select("id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    return out.select("id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the smallest identifier of each component."""
    dropped = written(near_duplicates(docs, id_col, text_col).filter("not kept").select("id").distinct(), "near-dropped")
    return filtered(docs, id_col, dropped, "left_anti")
