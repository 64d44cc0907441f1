"""From documents to packed training sequences: five stages, each read from the files of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import _common, exact_dedup, jaccard_join, language_id, mixing, packing


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or of no clear language; profiles are learnt from the labelled documents."""
    return language_id.accepted(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for white space, the one with the smallest id stays."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of at least 0.75, the one with the smallest id stays."""
    return jaccard_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which their sources interleave by weight; the files keep that order, and packing reads it from them."""
    return mixing.mixed(docs, seed=17)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and its place in a sequence of at most 4096 tokens, in the order of the
    files of ``docs``; ``packing.write_sequences`` makes training sequences of them."""
    import public_tokenizers

    order = mixing.file_order(docs)
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), coded=True, keep=order)
    return packing.decoded(packing.pack(parts, order=list(order))).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language profiles and tokens can't be expressed in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _common.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
