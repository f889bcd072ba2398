"""A corpus pipeline: the documents of good quality, once each, without benchmark passages, packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontamination import decontaminated
from tessera.llm.exact_dedup import distinct_documents
from tessera.llm.minhash import one_of_each_group
from tessera.llm.packing import pack, token_pieces
from tessera.llm.quality import good_documents
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import input_table, new_path, temporary, written, written_at

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, input_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, input_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)
    return pack(written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), capacity=2048)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]

#: The learned weights, the signatures and the token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:  # what the stage stores on its way goes when its result is there
            docs = written_at(stage(spark, docs, sf_dir), keep(new_path(spark, name)))
    return STAGES[-1][1](spark, docs, sf_dir)
