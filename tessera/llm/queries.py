"""The numbered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compaction import sharded
from .conversation_repair import damaged, rows_of, verdicts
from .decontamination import contaminated
from .exact_dedup import exact_duplicates
from .fill_in_middle import fill_in_middle, restored
from .language_id import held_out, identified
from .license_scan import license_scan
from .minhash import near_duplicates
from .packing import pack, token_pieces
from .pii import KINDS, personal_data
from .quality import quality_verdicts
from .shared import input_table, new_path, written
from .substring_dedup import repeated_passages
from .token_counts import token_counts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(input_table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identified(input_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(input_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(input_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)
    return pack(written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), capacity=2048)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(input_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "first_word", "n_words")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document ended up: shard (run/file), tier of the run, version of the manifest, and the document's bytes."""
    docs = input_table(spark, sf_dir, "documents")
    store = sharded(docs, new_path(spark, "shards"))
    manifest = store.manifest()
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    version = F.lit(manifest["version"]).alias("version")
    if not manifest["runs"]:
        return docs.select("doc_id", F.lit("").alias("shard"), F.lit(0).alias("tier"), version, n_bytes)
    # few: each tier has less than fanout runs, and tiers grow by that factor
    tiers = F.create_map(*(F.lit(x) for run in manifest["runs"] for x in (run.name, run.tier)))
    return store.read().select("doc_id", F.col("__shard").alias("shard"), tiers[F.substring_index("__shard", "/", 1)].alias("tier"), version, n_bytes)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "log_weight", F.col("key").alias("gumbel_key"), "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(input_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(input_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(input_table(spark, sf_dir, "documents"), size=50)
    kept = F.when(F.col("kept_text").isNull(), F.col("digest")).otherwise(F.sha2("kept_text", 256))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", kept.alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restored(fill_in_middle(input_table(spark, sf_dir, "documents")))
    digests = (F.sha2(name, 256).alias(f"{name}_sha256") for name in ("output", "restored"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(damaged(rows_of(input_table(spark, sf_dir, "conversations"))))
    return found.withColumnRenamed("digest", "repaired_sha256")


def _after(x: str, wanted: str) -> str:
    """SQL for what a row does as the wanted role after the state ``x``: kept, or with its role changed."""
    changed = ""
    if wanted != "s":
        role = "user" if wanted == "u" else "assistant"
        changed = f"WHEN symbol <> 'x' THEN {{'c': {x}.c + 2 + cut, 'a': {x}.a || 'R', 't': list_append({x}.t, '{role}:' || text)}}"
    kept = f"WHEN symbol = '{wanted}' THEN {{'c': {x}.c + cut, 'a': {x}.a || 'K', 't': list_append({x}.t, role || ':' || text)}}"
    return f"CASE WHEN {x} IS NULL THEN NULL {kept} {changed} END"


def _gone(state: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 3, 'a': {state}.a || 'D', 't': {state}.t}} END"


def _put(state: str, role: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 2, 'a': {state}.a || 'I', 't': list_append({state}.t, '{role}:')}} END"


#: One step a row: the cheapest (cost, audit, rows) that end with nothing (e), a system row (s), a user row (o) or an assistant row (d).
_REPAIR_SQL = rf"""
    WITH RECURSIVE base AS (SELECT row_number() OVER () AS row_id, conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
    bits AS (SELECT *, list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(conv || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda k: CAST(256 AS BIGINT)))))) AS b FROM base),
    drawn AS (SELECT *, xor(list_reduce(b, lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS f FROM bits),
    hurt AS (SELECT row_id, conv, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
    placed AS (SELECT *, row_number() OVER w AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink, substr(role, 1, 1) AS initial,
        lag(substr(role, 1, 1)) OVER w AS before FROM hurt WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, row_id, copy)),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 AS again FROM placed),
    faults AS (SELECT *, ink = '' AS blank, ink <> '' AND again AS duplicate, ink <> '' AND NOT again AND right(ink, 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
    symbols AS (SELECT conv, k, role, text, CAST(truncated AS BIGINT) AS cut, CASE WHEN blank OR duplicate THEN 'x' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS symbol FROM faults),
    way AS (
        SELECT conv, CAST(0 AS BIGINT) AS k, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS e, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s,
            {{'c': CAST(2 AS BIGINT), 'a': 'I', 't': ['user:']}} AS o, {{'c': CAST(4 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']}} AS d FROM (SELECT DISTINCT conv FROM base)
        UNION ALL
        SELECT conv, k, e, s, o, list_min([d0, {_put("o", "assistant")}]) AS d FROM (
            SELECT conv, k, e, s, list_min([o0, {_put("e", "user")}, {_put("s", "user")}, {_put("d0", "user")}]) AS o, d0 FROM (
                SELECT conv, y.k AS k, {_gone("e")} AS e, list_min([{_gone("s")}, {_after("e", "s")}]) AS s,
                    list_min([{_gone("o")}, {_after("e", "u")}, {_after("s", "u")}, {_after("d", "u")}]) AS o0, list_min([{_gone("d")}, {_after("o", "a")}]) AS d0
                FROM way JOIN symbols y USING (conv) WHERE y.k = way.k + 1))),
    counts AS (SELECT conv, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv),
    ended AS (SELECT conv, list_min([e, d]) AS r FROM way LEFT JOIN counts USING (conv) WHERE k = coalesce(n, 0))
    SELECT CASE WHEN conv <> ' ' THEN CAST(conv AS BIGINT) END AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, r.c AS cost, r.a AS audit, sha256(array_to_string(r.t, chr(10))) AS repaired_sha256 FROM ended LEFT JOIN counts USING (conv)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_language_id, op3_minhash_near_dedup, op4_best_fit_packing, op5_license_scan, op6_decontamination, op7_sharding, op8_quality_classifier, op9_exact_dedup, op10_token_counts, op11_substring_dedup, op12_fill_in_middle, op13_conversation_repair, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": r"""
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
        "op11_substring_dedup": r"""
            WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
            starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM d),
            windows AS (SELECT doc_id, p, sha256(array_to_string(list_slice(words, p, p + 49), ' ')) AS w FROM starts),
            least AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY 1),
            hits AS (SELECT doc_id, p FROM windows JOIN least USING (w) WHERE low < doc_id),
            gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM hits),
            placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d),
            left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM placed ANTI JOIN gone USING (doc_id, k) GROUP BY 1),
            removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
        "op12_fill_in_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
            drawn AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (n + 1) AS b,
                t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= 90 AS plain,
                CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 20 AS suffix_first FROM d),
            parts AS (SELECT *, substring(t, 1, CAST(least(a, b) AS BIGINT)) AS prefix, substring(t, CAST(least(a, b) AS BIGINT) + 1, CAST(greatest(a, b) - least(a, b) AS BIGINT)) AS middle,
                substring(t, CAST(greatest(a, b) AS BIGINT) + 1) AS suffix FROM drawn)
            SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
                CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
                sha256(CASE WHEN plain THEN t WHEN suffix_first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
                sha256(t) AS restored_sha256 FROM parts""",
        "op13_conversation_repair": _REPAIR_SQL,
    }
