import math

from pyspark.sql import functions as F

from lectern.operators import assemble, index, retrieve


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "id bigint, doc_name string, text string")


def test_keyword_phrases_and_substrings(spark):
    chunks = chunk_rows(spark, [(1, "d", "Emotional cutoff and self, myself"), (2, "d", "cutoff self"), (3, "e", None), (4, None, "emotional cutoff")])
    queries = spark.createDataFrame([(1, '"emotional cutoff" self'), (2, ""), (3, None), (4, "the and")], "query_id bigint, query string")
    got = [tuple(r) for r in retrieve.keyword_search(chunks, queries, 5).orderBy("query_id", "rank").select("query_id", "rank", "id", "hits").collect()]
    assert got == [(1, 1, 1, 5), (1, 2, 4, 3)]


def test_fusion(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id bigint, id string, rank int")
    two = spark.createDataFrame([(1, "a", 2)], "query_id bigint, id string, rank int")
    got = {r["id"]: r["score"] for r in retrieve.fuse(one, two, 5).collect()}
    assert math.isclose(got["a"], 1 / 60 + 1 / 61) and math.isclose(got["b"], 1 / 61)


def test_embedding_search_skips_bad_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0]), (7, [2.0, 0.0])], "id bigint, vector array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (10, None)], "query_id bigint, vector array<float>")
    got = [(r["rank"], r["id"]) for r in retrieve.embedding_search(vectors, queries, 5).orderBy("rank").collect()]
    assert got == [(1, 7), (2, 1), (3, 2)]
    assert retrieve.embedding_search(vectors, queries.where("false"), 5).count() == 0


def test_boosted_vectors_keep_k_rows(spark):
    """A boost is applied before the cut, and batches put out no more than k rows a query."""
    vectors = spark.createDataFrame([(k, [1.0, k / 100]) for k in range(200)], "id bigint, vector array<float>").repartition(2)
    docs = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(200)], "id bigint, doc_name string")
    boosts = spark.createDataFrame([("a", 3.0)], "doc_name string, boost double")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id bigint, vector array<float>")
    got = [(r["query_id"], r["rank"], r["id"]) for r in retrieve.embedding_search(vectors, queries, 3, docs, boosts).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 199), (2, 2, 197), (2, 3, 195)]


def test_keyword_search_by_postings_equals_that_by_texts(spark):
    chunks = chunk_rows(spark, [(1, "d", "Emotional cutoff, cut-off; uncut aaa"), (2, "e", "CUT cuts é_cut"), (3, "f", None), (4, "g", "x-ray aa aaaa")])
    queries = spark.createDataFrame([(1, "cut cuts"), (2, '"cut-off" emotional'), (3, "aaa x-ray"), (4, "cutting")], "query_id bigint, query string")
    plain = sorted(map(tuple, retrieve.keyword_search(chunks, queries, 5).collect()))
    assert plain == sorted(map(tuple, retrieve.keyword_search(chunks, queries, 5, posted=index.all_words(chunks)).collect()))
    assert {r[0] for r in plain} >= {1, 2, 3}


def test_batch_equals_single_queries(spark):
    chunks = chunk_rows(spark, [(k, f"d{k % 3}", "alpha beta " * (k % 4) + f"gamma delta{k % 5} common") for k in range(40)])
    queries = spark.createDataFrame([(1, "alpha gamma"), (2, "delta1 beta beta"), (3, "unknown")], "query_id bigint, query string")
    model = index.bm25(chunks.select("id", "text"))
    every = sorted(tuple(r) for r in retrieve.term_search(model.weights, index.bm25_queries(queries), 7).collect())
    single = []
    for q in (1, 2, 3):
        single += [tuple(r) for r in retrieve.term_search(model.weights, index.bm25_queries(queries.where(F.col("query_id") == q)), 7).collect()]
    assert every == sorted(single)


def test_tfidf_rows_have_length_one_and_empty_tables_work(spark):
    chunks = chunk_rows(spark, [(1, "d", "red green blue"), (2, "d", "red green"), (3, "d", ""), (4, "d", None)])
    model = index.tfidf(chunks.select("id", "text"))
    assert {r["term"] for r in model.vocabulary.collect()} == {"red", "green", "red green"}
    norms = model.weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(math.isclose(r["n"], 1.0) for r in norms) and len(norms) == 2
    assert index.tfidf(chunks.select("id", "text").where("false")).weights.count() == 0
    assert index.bm25(chunks.select("id", "text").where("false")).weights.count() == 0


def test_windows_and_groups(spark):
    chunks = chunk_rows(spark, [(1, "d", "a"), (2, "d", "b"), (3, "e", "c"), (4, "d", "b"), (5, None, "x"), (6, "e", None)])
    hits = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 5)], "query_id bigint, rank int, id bigint")
    near = assemble.context_windows(hits, assemble.positions(chunks), chunks, 1)
    assert sorted((r["id"], r["offset"], r["near_id"]) for r in near.collect()) == [(2, -1, 1), (2, 0, 2), (2, 1, 4), (3, 0, 3), (3, 1, 6)]
    groups = {r["doc_name"]: (r["doc_ord"], r["texts"]) for r in assemble.group_context(near.drop("near_text"), chunks).collect()}
    assert groups == {"d": (1, ["a", "b"]), "e": (2, ["c", None])}
    assert [assemble.window_width(n) for n in (0, 1, 2, 3, 5)] == [0, 0, 0, 1, 2]


def test_staged_merge_is_idempotent(spark):
    rows = spark.createDataFrame([(1, 1, 5, "d"), (1, 2, None, "e"), (1, 3, None, "e")], "query_id bigint, rank int, id bigint, doc_name string")
    once = assemble.merge_staged(rows, rows)
    assert sorted((r["id"] or -1, r["rank"], r["source"]) for r in once.collect()) == [(-1, 2, 0), (5, 1, 0)]


def test_top_documents_ties(spark):
    scored = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.1), (1, 5, 1.6), (1, 6, 0.0)], "query_id bigint, id bigint, score double")
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b"), (6, "c")], "id bigint, doc_name string")
    got = [(r["rank"], r["doc_name"], r["id"], round(r["score"], 6)) for r in retrieve.top_documents(scored, docs, 5).orderBy("rank").collect()]
    assert got == [(1, "b", 5, 1.6), (2, "a", 3, 1.5)]
    assert retrieve.mode_of("hybrid") == "hybrid" and retrieve.mode_of("other") == "combined"
