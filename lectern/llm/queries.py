"""Queries of the training-data operators, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.common import read_table
from lectern.llm import bpe, encodings, neardup, packing, scans, spam, spans, topn


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits of every document name."""
    best = topn.top_n_per_group(read_table(spark, sf_dir, "results"), "doc_name", "relevance_score", "result_id", 5)
    return best.select("doc_name", "result_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of leftovers of printed pages in each chunk."""
    return scans.scan_noise(read_table(spark, sf_dir, "chunk_metadata"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with leftovers as continuous paragraphs."""
    return scans.repair_scans(read_table(spark, sf_dir, "chunk_metadata"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and fields that were read in a wrong encoding."""
    return encodings.repair_encodings(read_table(spark, sf_dir, "chunk_metadata")).select("id", "field")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored values with the chain of encodings undone."""
    return encodings.repair_encodings(read_table(spark, sf_dir, "chunk_metadata"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of chunks with a similarity of at least 0.7 on three-word shingles."""
    return neardup.similar_pairs(read_table(spark, sf_dir, "chunk_metadata"), similarity=0.7, words=3, least_words=20)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with the class of its equals, the group of its similars and the number of its links."""
    return neardup.groups(read_table(spark, sf_dir, "chunk_metadata"), similarity=0.7, words=3, least_words=20)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 200 characters of a chunk that stand word for word in another chunk."""
    return spans.shared_spans(read_table(spark, sf_dir, "chunk_metadata"))


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each chunk is shared with others."""
    return spans.shared_amount(read_table(spark, sf_dir, "chunk_metadata"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode(read_table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of 2,048 tokens."""
    return packing.pack(bpe.count_tokens(read_table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly repeated keywords, links or product tags."""
    return spam.spam_pages(read_table(spark, sf_dir, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_shared": p5_shared,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
}

ORACLES: dict[str, str] = {
    "p1_found": """
        WITH r AS (SELECT DISTINCT result_id, doc_name, relevance_score FROM results
                   WHERE doc_name IS NOT NULL AND relevance_score IS NOT NULL AND NOT isnan(relevance_score))
        SELECT doc_name, result_id FROM r
        QUALIFY row_number() OVER (PARTITION BY doc_name ORDER BY relevance_score DESC, result_id) <= 5""",
}
