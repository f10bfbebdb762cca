"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.llm import (
    alignment,
    bpe,
    conversations,
    fingerprints,
    html_text,
    lm,
    minhash,
    neighbours,
    packing,
    quality,
    statements,
    substrings,
    toxicity,
    warc,
)
from worksight.llm.common import crc_fold, table
from worksight.sources.scratch import new_table_path


def op1_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the attention model and by word unigrams, fold 0 of 10 held out."""
    docs = table(spark, sf_dir, "documents")
    subwords = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return lm.fit_and_score(docs, *subwords, folds=10)


def op2_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by minimum-cut labelling of their blocks."""
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op3_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of power-of-two length, one row for each piece."""
    packed = packing.pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        with_ids=False,
    )
    return packed.drop("input_ids")


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 50 bytes that an earlier document has."""
    docs = table(spark, sf_dir, "documents")
    return substrings.remove_repeats(docs, threshold=50).drop("kept", "extra")


def op5_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a factorization machine fitted outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=5)
    return toxicity.score(docs, machine).select(
        "doc_id", (crc_fold(docs["doc_id"], 5) == 0).alias("held_out"), "score", "predicted"
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: three-word shingles, similarity 0.85."""
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, width=3, percent=85)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, with digests of both."""
    return bpe.round_trip_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the capture index."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archives(pages, new_table_path(spark, "warc"), min_bytes=0)
    return warc.read_back(archive, pages).drop("url")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the tokens of two tokenizers, aligned by their common ends."""
    return alignment.alignment_statistics(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def op12_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of all documents and the verdict of an isolation forest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by the checksum of their rows, and repaired at least cost."""
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = [
        op1_attention_lm,
        op2_min_cut_text,
        op3_pack_binary,
        op4_repeated_strings,
        op5_prefix_fingerprints,
        op6_toxicity,
        op7_minhash,
        op8_byte_bpe,
        op9_warc_index,
        op10_nn_descent,
        op11_token_alignment,
        op12_quality_forest,
        op13_conversation_repair,
    ]
    return {query.__name__: query for query in registered}


oracle_sql = statements.oracle_sql
