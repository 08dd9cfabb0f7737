"""Retrieval of a batch of queries over all chunks: TF-IDF, BM25, keyword, embedding, merged and per document.

Every search gives ``query_id, rank, id, score`` (and what it adds); texts are joined afterwards, so no plan carries
them through its shuffles. Ranks use the score rounded to 9 decimals, then the tie rule of the search.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lectern.common import spread
from lectern.functions.text import STOP_WORDS, SPACE, occurrences, stems

#: Distinct word variants counted in one pass over the texts, and query vectors scored in one pass over the vectors.
VARIANT_BLOCK, VECTOR_BLOCK = 2_000, 2_000


def _best(by: str, tie: tuple[Column, ...]) -> WindowSpec:
    return Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), *tie)


def first_k(scored: DataFrame, k: int, *tie: Column, by: str = "query_id") -> DataFrame:
    """The ``k`` best rows of each query by ``score``, with their ``rank`` from 1. Rows without a positive score are none."""
    return scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(_best(by, tie))).where(F.col("rank") <= k)


def first_places(scored: DataFrame, k: int, *tie: Column, by: str = "query_id") -> DataFrame:
    """The rows that ``first_k`` orders into the ``k`` best places of each query, all rows of equal place among them: of a table
    that stores some rows twice, at least what ``first_k`` takes of it once they are gone."""
    return scored.where(F.col("score") > 0).withColumn("_place", F.dense_rank().over(_best(by, tie))).where(F.col("_place") <= k).drop("_place")


def boosted(scored: DataFrame, doc_of: DataFrame | None, boosts: DataFrame | None) -> DataFrame:
    """``scored`` with its score times the boost of the chunk's document; ``boost`` is 1 without a rule or a name."""
    if boosts is None:
        return scored.withColumn("boost", F.lit(1.0))
    joined = scored.join(doc_of.select("id", "doc_name"), "id", "left").join(boosts.select("doc_name", "boost"), "doc_name", "left").drop("doc_name")
    joined = joined.withColumn("boost", F.coalesce("boost", F.lit(1.0)))
    return joined.withColumn("score", F.col("score") * F.col("boost"))


def score_terms(weights: DataFrame, query_terms: DataFrame) -> DataFrame:
    """``query_id, id, score``: the sum over shared terms of the two weights."""
    pairs = weights.join(query_terms.withColumnRenamed("weight", "q"), "term")
    return pairs.groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))


def term_search(weights: DataFrame, query_terms: DataFrame, k: int, doc_of: DataFrame | None = None, boosts: DataFrame | None = None) -> DataFrame:
    """TF-IDF or BM25 search: best ``k`` chunks a query after boosting; equal scores by descending id."""
    return first_k(boosted(score_terms(weights, query_terms), doc_of, boosts), k, F.desc("id")).select("query_id", "rank", "id", "score", "boost")


def keyword_terms(queries: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """``query_id, term_no, phrase, variant``: quoted phrases, and the other words with their variants.

    Words keep their punctuation, must be longer than two characters and no stop words; a repeated word counts again.
    """
    low = F.lower(F.coalesce("query", F.lit("")))
    phrases = F.transform(F.regexp_extract_all(low, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.struct(F.lit(True).alias("phrase"), F.array(p).alias("variants")))
    words = F.filter(F.split(F.regexp_replace(low, '"[^"]+"', ""), f"{SPACE}+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))
    terms = F.concat(phrases, F.transform(words, lambda w: F.struct(F.lit(False).alias("phrase"), stems(w).alias("variants"))))
    return queries.select("query_id", F.posexplode(terms).alias("term_no", "t")).select("query_id", "term_no", F.col("t.phrase").alias("phrase"), F.explode("t.variants").alias("variant"))


def variant_counts(chunks: DataFrame, variants: list[str]) -> DataFrame:
    """``id, variant, n``: how often each variant stands in a chunk's lower-cased text, where it does."""
    lowered = spread(chunks.select("id", F.lower("text").alias("low")))
    low = F.col("low")
    counted = F.transform(F.array(*map(F.lit, variants)), lambda v: F.when(F.contains(low, v), F.struct(v.alias("variant"), occurrences(low, v).alias("n"))))
    return lowered.select("id", F.explode(F.filter(counted, lambda c: c.isNotNull())).alias("c")).select("id", "c.variant", "c.n")


def posted_counts(posted: DataFrame, variants: list[str]) -> DataFrame:
    """``variant_counts`` of variants that are parts of words, from ``posted (id, term, tf)``: the variants are looked for in
    each different word, not in each text."""
    words = variant_counts(posted.select(F.col("term").alias("id"), F.col("term").alias("text")).distinct(), variants).withColumnRenamed("id", "term")
    return posted.join(words, "term").groupBy("id", "variant").agg(F.sum(F.col("tf") * F.col("n")).cast("int").alias("n"))


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int, boosts: DataFrame | None = None, stop_words=STOP_WORDS, posted: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, id, doc_name, score, boost, hits``: the best chunk of each document by keyword hits.

    A phrase counts threefold and must occur; of a word's variants the most frequent counts. Hits are non-overlapping
    substrings. In a document the earlier of equal chunks counts; equal documents come in the order of their first
    matching chunk. The distinct variants of all queries are counted in blocks, once for each chunk. Chunks without
    a document name form one document, as a null name does elsewhere. With ``posted (id, term, tf)``, all words of the
    chunks with their number, only variants with spaces or punctuation are looked for in the texts.
    """
    terms = keyword_terms(queries, stop_words)
    names = [r[0] for r in terms.select("variant").distinct().orderBy("variant").toLocalIterator()]
    within = [v for v in names if posted is not None and v.replace("_", "a").isalnum()]
    across = [v for v in names if posted is None or not v.replace("_", "a").isalnum()]
    blocks = [posted_counts(posted, within[i : i + VARIANT_BLOCK]) for i in range(0, len(within), VARIANT_BLOCK)]
    blocks += [variant_counts(chunks, across[i : i + VARIANT_BLOCK]) for i in range(0, len(across), VARIANT_BLOCK)]
    if not blocks:
        blocks = [chunks.select("id", F.lit("").alias("variant"), F.lit(0).alias("n")).where("false")]
    hits = reduce(DataFrame.unionByName, blocks).join(terms, "variant").groupBy("query_id", "id", "term_no", "phrase").agg(F.max("n").alias("n"))
    phrases = terms.where("phrase").groupBy("query_id").agg(F.count_distinct("term_no").alias("phrases"))
    sums = hits.groupBy("query_id", "id").agg(F.sum(F.col("n") * F.when(F.col("phrase"), 3).otherwise(1)).alias("hits"), F.sum(F.col("phrase").cast("int")).alias("with"))
    kept = sums.join(phrases, "query_id", "left").where(F.col("with") == F.coalesce("phrases", F.lit(0)))
    scored = boosted(kept.select("query_id", "id", "hits", F.col("hits").cast("double").alias("score")), chunks, boosts)
    scored = scored.join(chunks.select("id", "doc_name"), "id")
    best = scored.groupBy("query_id", "doc_name").agg(F.min("id").alias("first"), F.max_by(F.struct("id", "score", "boost", "hits"), F.struct(F.round("score", 9), -F.col("id"))).alias("b"))
    return first_k(best.select("query_id", "doc_name", "first", "b.*"), k, F.asc("first")).select("query_id", "rank", "id", "doc_name", "score", "boost", "hits")


def combined_search(semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, id, score, mode``: the rows of both searches, the semantic one where both have a chunk, by raw
    score; equal scores in keyword order, then semantic order."""
    s, w = semantic.select("query_id", "id", F.col("score").alias("s"), F.col("rank").alias("sr")), keyword.select("query_id", "id", F.col("score").alias("w"), F.col("rank").alias("wr"))
    both = s.join(w, ["query_id", "id"], "full_outer").withColumn("score", F.coalesce("s", "w")).withColumn("mode", F.when(F.col("s").isNotNull(), "semantic").otherwise("keyword"))
    return first_k(both, k, F.asc_nulls_last("wr"), F.asc_nulls_last("sr")).select("query_id", "rank", "id", "score", "mode")


def embedding_search(vectors: DataFrame, queries: DataFrame, k: int, doc_of: DataFrame | None = None, boosts: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, id, score, boost``: cosine of ``queries (query_id, vector)`` and ``vectors (id, vector)``, exact.

    Queries are scored in blocks; boosts are joined to the vectors, so each Arrow batch of vectors keeps its ``k`` best rows
    a query, and the shuffle holds no more than that. Null and zero vectors and vectors of another length than the query's
    match nothing. Equal scores by descending id.
    """
    found = []
    rows = queries.where("vector is not null").select("query_id", "vector").orderBy("query_id")
    weighed = spread(boosted(vectors.select("id", "vector", F.lit(1.0).alias("score")), doc_of, boosts).select("id", "vector", "boost"))
    for block in _blocks(rows, VECTOR_BLOCK):
        ids = block["query_id"].to_numpy()
        matrix = np.array([np.asarray(v, float) for v in block["vector"]])
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def score(frames, shared=shared):
            ids, unit = shared.value
            for frame in frames:
                frame = frame[frame["vector"].map(lambda v: v is not None and len(v) == unit.shape[1])]
                if not len(frame):
                    continue
                m = np.array([np.asarray(v, float) for v in frame["vector"]])
                norm = np.linalg.norm(m, axis=1)
                boost, at = frame["boost"].to_numpy(), frame["id"].to_numpy()
                scores = np.round(np.where(norm > 0, unit @ m.T / np.maximum(norm, 1e-300), 0.0), 12) * boost
                order = np.lexsort((np.broadcast_to(-at, scores.shape), -np.round(scores, 9)))[:, :k]
                best = np.take_along_axis(scores, order, 1)
                kept = best > 0
                yield pd.DataFrame({"query_id": np.repeat(ids, kept.sum(1)), "id": at[order][kept], "score": best[kept], "boost": boost[order][kept]})

        found.append(weighed.mapInPandas(score, "query_id bigint, id bigint, score double, boost double"))
    if not found:
        found = [vectors.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(1.0).alias("boost")).where("false")]
    return first_k(reduce(DataFrame.unionByName, found), k, F.desc("id")).select("query_id", "rank", "id", "score", "boost")


def _blocks(rows: DataFrame, size: int):
    """The rows in pandas frames of ``size``; the driver holds one at a time."""
    block = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield pd.DataFrame(block, columns=rows.columns)
            block = []
    if block:
        yield pd.DataFrame(block, columns=rows.columns)


def fuse(first: DataFrame, second: DataFrame, k: int, c: int = 60) -> DataFrame:
    """``query_id, rank, id, score, share``: reciprocal rank fusion of two ranked lists; equal sums by ascending id.

    ``share`` is the score as a share of the best possible one."""
    a, b = (x.select("query_id", "id", (F.lit(1.0) / (c - 1 + F.col("rank"))).alias(n)) for x, n in ((first, "a"), (second, "b")))
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("score", F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)))
    return first_k(both, k, F.asc("id")).select("query_id", "rank", "id", "score", (F.col("score") / (2.0 / c)).alias("share"))


def top_documents(scored: DataFrame, doc_of: DataFrame, k: int, boosts: DataFrame | None = None, chunks_each: int = 3) -> DataFrame:
    """``query_id, rank, doc_name, id, score``: documents by the sum of their best three raw chunk scores times their boost.

    ``id`` is the best chunk, of equal ones the later; equal documents come in the order of their first positive chunk.
    """
    positive = scored.where(F.col("score") > 0).join(doc_of.select("id", "doc_name"), "id").where("doc_name is not null")
    order = Window.partitionBy("query_id", "doc_name").orderBy(F.desc(F.round("score", 9)), F.desc("id"))
    ranked = positive.withColumn("n", F.row_number().over(order)).where(F.col("n") <= chunks_each)
    firsts = positive.groupBy("query_id", "doc_name").agg(F.min("id").alias("first"))
    docs = ranked.groupBy("query_id", "doc_name").agg(F.sum("score").alias("score"), F.max(F.when(F.col("n") == 1, F.col("id"))).alias("id")).join(firsts, ["query_id", "doc_name"])
    if boosts is not None:
        docs = docs.join(boosts.select("doc_name", "boost"), "doc_name", "left").withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0)))
    return first_k(docs, k, F.asc("first")).select("query_id", "rank", "doc_name", "id", "score")


def relevance_percent(score: Column) -> Column:
    """A score in whole per cent, cut off."""
    return (score * 100).cast("int")


#: Retrieval modes by name; any other name is the combined mode.
MODES = ("top-docs", "semantic", "keyword", "embedding", "hybrid")


def mode_of(name: str | None) -> str:
    return name if name in MODES else "combined"


def mode_column(name: Column) -> Column:
    """``mode_of`` for a column."""
    return F.when(name.isin(*MODES), name).otherwise("combined")
