"""Chunking, import, statistics and journal plans over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.common import read_table
from lectern.functions import rules
from lectern.functions import text as X
from lectern.operators import assemble, chunking, index, journal
from lectern.plans import search
from lectern.sources import writers
from lectern.sources.transcripts import import_transcripts


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", chunking.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("n", "s")).select("doc_id", "n", F.length("s.text").alias("characters"), F.col("s.page").alias("page"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.sentence_chunks(documents(spark, d), "doc_id", "text")
    return rows.select("doc_id", "seq", "page", F.length("text").alias("characters"), F.md5("text").alias("digest"))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.section_chunks(documents(spark, d), "doc_id", "text")
    return rows.select("doc_id", "section_title", F.length("text").alias("characters"), F.md5("text").alias("digest"))


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk_table(documents(spark, d))
    return rows.select("id", "doc_name", "section_title", "char_count", "page", "chunk_pos", "doc_chunk_count", F.md5("text").alias("digest"))


def chunk_positions(spark: SparkSession, d: str) -> DataFrame:
    store = index.chunks_once(read_table(spark, d, "chunk_metadata"), "page", "chunk_pos", "doc_chunk_count")
    return store.select("id", X.position_badge(F.col("page"), F.col("chunk_pos"), F.col("doc_chunk_count")).alias("badge"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.corpus_statistics(read_table(spark, d, "chunk_metadata"))


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunk_metadata").select("doc_name").where("doc_name is not null").distinct()


def doc_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return assemble.document_catalogue(search.chunks(spark, d), search.names(spark, d))


def known_authors(spark: SparkSession, d: str) -> DataFrame:
    return rules.known_authors(read_table(spark, d, "author_map"))


def tokenize_bm25(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("words"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_df(spark: SparkSession, d: str) -> DataFrame:
    return index.term_statistics(index.postings(documents(spark, d).select(F.col("doc_id").alias("id"), "text")))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return index.chunks_once(read_table(spark, d, "chunk_metadata"), "text")


def tfidf_vocab(spark: SparkSession, d: str) -> DataFrame:
    return index.tfidf(texts(spark, d)).vocabulary.select("term", "df", "total", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = index.tfidf(texts(spark, d)).weights
    return weights.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"))


def index_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What the stored index of the directory holds."""
    bm25 = search.model(spark, d, "bm25")
    return index.index_metrics(search.chunks(spark, d), search.model(spark, d, "tfidf").vocabulary, read_table(spark, d, "embeddings"), bm25)


def stored_weights(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 postings of the stored index by term."""
    return search.model(spark, d, "bm25").weights.groupBy("term").agg(F.count("*").alias("chunks"), F.round(F.sum("weight"), 5).alias("total"))


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with the vector of an encoder that counts characters, spaces and line breaks."""

    def encoder():
        return lambda batch: [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in batch]

    rows = writers.build_embeddings(texts(spark, d), encoder)
    return rows.select("chunk_id", *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("characters", "spaces", "breaks"))))


def stale_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return index.stale_embeddings(read_table(spark, d, "chunk_metadata"), read_table(spark, d, "embeddings"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return search.chunks(spark, d).select("id", X.excerpt(F.col("text"), 220).alias("excerpt"))


def formatted_chunks(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("text", r"^\[([^\n\]]+)\]\n\n", 1)
    return search.chunks(spark, d).select("id", X.format_chunk(F.col("text"), title).alias("body"))


def view_source(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of every document."""
    return search.chunks(spark, d).where("doc_name is not null").groupBy("doc_name").agg(F.min_by(F.md5("text"), "id").alias("digest"), F.min("id").alias("id"))


def frontmatter(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).where(F.col("text").startswith("---\n")).select("doc_id", X.frontmatter(F.col("text")).alias("m"))
    return rows.select("doc_id", *(F.element_at("m", F.lit(k)).alias(n) for k, n in (("Title", "title"), ("Presenter", "presenter"), ("Lecture date", "date"))))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    rows = import_transcripts(documents(spark, d), "doc_name", "text")
    return rows.select("stem", "file_name", "sections", "words", F.md5("text").alias("digest"))


def transcript_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of an import of all transcripts; of several with one name the last counts."""
    rows = import_transcripts(documents(spark, d), "doc_name", "text").withColumn("path", F.concat_ws(" ", "stem", F.md5("text")))
    return writers.text_files(rows).select("file_name", "copies", F.md5("text").alias("digest"))


def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(X.nfkc("text")).alias("digest"), F.length(X.nfkc("text")).alias("characters"))


def contents_tables(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where(F.col("text").startswith("CONTENTS\n"))


def toc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return journal.toc_tokens(contents_tables(spark, d), "doc_id", "text")


def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    return journal.toc_entries(toc_tokens(spark, d), "doc_id")


def toc_files(spark: SparkSession, d: str) -> DataFrame:
    rows = toc_entries(spark, d)
    return rows.select("doc_id", "ord", journal.article_file_name("Journal", F.col("doc_id").cast("string"), F.col("author"), F.col("title")).alias("file_name"))


def ocr_entries(spark: SparkSession, d: str) -> DataFrame:
    flat = F.regexp_replace("text", "\t", "\n").alias("text")
    return journal.ocr_entries(contents_tables(spark, d).select("doc_id", flat), "doc_id", "text")


def scanned_pages(spark: SparkSession, d: str) -> DataFrame:
    """One text for each page of a scanned document: its chunks in order."""
    store = search.chunks(spark, d).where("page is not null and doc_name is not null and text is not null")
    return store.groupBy("doc_name", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("text"))


def page_map(spark: SparkSession, d: str) -> DataFrame:
    return journal.page_map(scanned_pages(spark, d), "doc_name", "page", "text")


def nearest_page(spark: SparkSession, d: str) -> DataFrame:
    """Every printed page between the first and last mapped one of a document."""
    mapped = page_map(spark, d)
    ends = mapped.where("journal_page < 1000").groupBy("issue").agg(F.min("journal_page").alias("a"), F.max("journal_page").alias("b"))
    return journal.nearest_pages(ends.select("issue", F.explode(F.sequence("a", "b")).alias("page")), mapped.where("journal_page < 1000"))


def article_starts(spark: SparkSession, d: str) -> DataFrame:
    """Every mapped page of a document as the start of an article."""
    mapped = page_map(spark, d).where("journal_page < 1000")
    return mapped.select("issue", F.col("journal_page").alias("ord"), F.col("journal_page").alias("page"))


def article_extents(spark: SparkSession, d: str) -> DataFrame:
    return journal.article_extents(article_starts(spark, d), page_map(spark, d))


def article_text(spark: SparkSession, d: str) -> DataFrame:
    texts = journal.article_texts(article_extents(spark, d), scanned_pages(spark, d), "doc_name", "page", "text")
    return texts.select("issue", "ord", "pages", F.md5("text").alias("digest"))


def article_records(spark: SparkSession, d: str) -> DataFrame:
    """Every article as a file, titled by the first line of its text."""
    starts, extents = article_starts(spark, d), article_extents(spark, d)
    texts = journal.article_texts(extents, scanned_pages(spark, d), "doc_name", "page", "text")
    first = F.regexp_extract("text", r"([^ \t\n\r\f\x0B][^\n]{0,40})", 1)
    titled = starts.join(texts, ["issue", "ord"], "left").select("issue", "ord", X.collapse(F.coalesce(first, F.lit(""))).alias("title"), F.lit("Unknown").alias("author"))
    rows = journal.article_records(titled, extents, texts, "Journal")
    return rows.select("issue", "ord", "file_name", F.length("record").alias("characters"), F.md5("record").alias("digest"), "warning")


def issue_contents(spark: SparkSession, d: str) -> DataFrame:
    """The first two pages of every scanned document as its contents table."""
    pages = scanned_pages(spark, d)
    first = pages.groupBy("doc_name").agg(F.min("page").alias("p"))
    issues = first.select(F.col("doc_name").alias("issue"), F.array("p", F.col("p") + 1).alias("toc_pages"), F.lit("TAB").alias("toc_format"), (F.col("p") > 500).alias("skip"))
    rows = journal.issue_contents(issues, pages, "doc_name", "page", "text")
    return rows.select("issue", "toc_format", F.length("text").alias("characters"), F.md5("text").alias("digest"))


def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and characters by author and boost with subtotals. An extension."""
    store = search.chunks(spark, d).where("doc_name is not null").join(search.names(spark, d), "doc_name")
    return store.rollup("author", "boost").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("characters"), F.grouping_id().cast("int").alias("level"))
