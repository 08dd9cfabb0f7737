"""Term statistics, TF-IDF and BM25 postings of a chunk store. Weights are kept sparse: one row a chunk and term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.common import materialize, once_per_key, spread
from lectern.functions.text import STOP_WORDS, tokens, with_bigrams


def chunks_once(chunks: DataFrame, *columns: str) -> DataFrame:
    """``id`` and the given columns, each chunk once also where it is stored twice."""
    return once_per_key(chunks.where("id is not null"), "id", *columns)


def postings(chunks: DataFrame, stop_words=STOP_WORDS, bigrams: bool = False, least: int = 3) -> DataFrame:
    """``id, term, tf`` of ``chunks (id, text)``; null and empty texts have none."""
    words = tokens(F.col("text"), stop_words, least)
    return spread(chunks.select("id", "text")).select("id", F.explode(with_bigrams(words) if bigrams else words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """``term, df, total``: in how many chunks a term occurs and how often."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def all_words(chunks: DataFrame) -> DataFrame:
    """``id, term, tf``: every word of ``chunks (id, text)`` with its number, stop words and short ones too."""
    return postings(chunks, (), least=1)


@dataclass
class Weighted:
    """``weights (id, term, weight)`` and ``vocabulary (term, ...)`` of one model; ``n`` chunks in all."""

    weights: DataFrame
    vocabulary: DataFrame
    n: int


def tfidf(chunks: DataFrame, stop_words=STOP_WORDS, max_features: int = 8000, min_df: int = 2) -> Weighted:
    """Sublinear TF-IDF over words of two characters and more and pairs of neighbours, rows of length 1.

    The vocabulary holds the terms of at least ``min_df`` chunks, of these the ``max_features`` most frequent, ties
    by term. ``n`` counts every chunk, also those without terms. The stop list is a parameter.
    """
    n = chunks.count()
    posted = materialize(postings(chunks, stop_words, bigrams=True, least=2))
    vocabulary = term_statistics(posted).where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_features)
    vocabulary = materialize(vocabulary.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0))
    return Weighted(_unit_rows(posted, vocabulary), vocabulary, n)


def _unit_rows(posted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id, term, weight`` of the vocabulary's terms, each id's weights scaled to length 1. A row's cells are one text's."""
    cells = posted.join(vocabulary.select("term", "idf"), "term").select("id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return cells.select("id", "term", (F.col("w") / norm).alias("weight"))


def tfidf_queries(queries: DataFrame, model: Weighted, stop_words=STOP_WORDS) -> DataFrame:
    """``query_id, term, weight`` of ``queries (query_id, query)`` in the model's vocabulary, rows of length 1."""
    posted = postings(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")), stop_words, bigrams=True, least=2)
    return _unit_rows(posted, model.vocabulary).withColumnRenamed("id", "query_id")


def bm25(chunks: DataFrame, stop_words=STOP_WORDS, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, words: DataFrame | None = None) -> Weighted:
    """BM25 weights: a query's score of a chunk is the sum of the weights of the query's words, repeats included.

    A negative idf is replaced by ``epsilon`` times the mean idf of all terms, negative ones included. Chunk lengths
    count the words after filtering; chunks without words count towards the mean length. ``words`` are the chunks'
    ``all_words`` where they are at hand, so that texts aren't split again.
    """
    n = chunks.count()
    posted = materialize(postings(chunks, stop_words)) if words is None else words.where((F.length("term") >= 3) & ~F.col("term").isin(*stop_words))
    lengths = posted.groupBy("id").agg(F.sum("tf").alias("dl"))
    mean_length = (lengths.agg(F.sum("dl")).first()[0] or 0) / max(n, 1)
    terms = term_statistics(posted).withColumn("raw", F.log(n - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5)))
    mean_idf = terms.agg(F.avg("raw")).first()[0] or 0.0
    terms = materialize(terms.withColumn("idf", F.when(F.col("raw") < 0, F.lit(epsilon * mean_idf)).otherwise(F.col("raw"))).drop("raw"))
    tf = F.col("tf")
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(float(mean_length or 1.0))))
    weights = posted.join(lengths, "id").join(terms.select("term", "idf"), "term").select("id", "term", (F.col("idf") * part).alias("weight"))
    return Weighted(weights, terms, n)


def bm25_queries(queries: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """``query_id, term, weight``: the words of each query with their number."""
    posted = postings(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")), stop_words)
    return posted.select(F.col("id").alias("query_id"), "term", F.col("tf").cast("double").alias("weight"))


def index_metrics(chunks: DataFrame, vocabulary: DataFrame, embeddings: DataFrame | None = None, bm25: Weighted | None = None) -> DataFrame:
    """``chunks, documents, features, vectors, has_embeddings, has_bm25``: one row about an index."""
    store = chunks_once(chunks, "doc_name").agg(F.count("*").alias("chunks"), F.count_distinct("doc_name").alias("documents"))
    features = vocabulary.agg(F.count("*").alias("features"))
    vectors = embeddings.agg(F.count("*").alias("vectors")) if embeddings is not None else features.select(F.lit(0).cast("bigint").alias("vectors"))
    return store.join(F.broadcast(features)).join(F.broadcast(vectors)).withColumns({"has_embeddings": F.col("vectors") > 0, "has_bm25": F.lit(bm25 is not None)})


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """``chunks, documents, characters``: one row."""
    once = chunks_once(chunks, "doc_name", "char_count")
    return once.agg(F.count("*").alias("chunks"), F.count_distinct("doc_name").alias("documents"), F.sum("char_count").alias("characters"))


def stale_embeddings(chunks: DataFrame, embeddings: DataFrame, chunk_key: str = "id", vector_key: str = "vec_id") -> DataFrame:
    """``key, missing``: keys that only one of the two tables has; ``missing`` says what they lack."""
    a, b = chunks.select(F.col(chunk_key).alias("key")).where("key is not null").distinct(), embeddings.select(F.col(vector_key).alias("key")).where("key is not null").distinct()
    return a.join(b, "key", "left_anti").withColumn("missing", F.lit("embedding")).unionByName(b.join(a, "key", "left_anti").withColumn("missing", F.lit("chunk")))
