"""From ranked chunks to context, references, prompts, messages and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import excerpt, format_chunk
from lectern.operators.chunking import with_global_number

#: Stands between the texts of one document.
GAP = "\n…\n"


def positions(chunks: DataFrame) -> DataFrame:
    """``id, doc_name, no``: chunks with a name, numbered by document and id over the whole table.

    Chunks of one document have consecutive numbers, so neighbours are found by an equality join on name and
    number, and no task needs a whole document. Texts aren't sorted along."""
    return with_global_number(chunks.where("doc_name is not null").select("id", "doc_name"), ["doc_name", "id"], "no")


def neighbours(hits: DataFrame, placed: DataFrame, width: int = 1) -> DataFrame:
    """``hits`` with ``doc_name, offset, near_id``: the chunks up to ``width`` places before and after each hit in its
    document, fewer at the document's ends. Hits without a place come out none."""
    own = hits.join(placed.select("id", "doc_name", "no"), "id")
    asked = own.withColumn("offset", F.explode(F.sequence(F.lit(-width), F.lit(width)))).withColumn("no", F.col("no") + F.col("offset"))
    return asked.join(placed.select("doc_name", "no", F.col("id").alias("near_id")), ["doc_name", "no"]).drop("no")


def context_windows(hits: DataFrame, placed: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """``neighbours`` with ``near_text``: only the texts of chunks near a hit are joined."""
    return neighbours(hits, placed, width).join(chunks.select(F.col("id").alias("near_id"), F.col("text").alias("near_text")), "near_id")


def window_width(chunks_per_document: int) -> int:
    """Places on either side for a report that shows so many chunks of a document."""
    return max(0, (chunks_per_document - 1) // 2)


def group_context(near: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, doc_name, doc_ord, texts``: the texts of ``neighbours`` of each query by document, each text once a document in
    order of rank and offset, documents numbered from 1 in the order of their first appearance.

    Equal texts are told by a digest (the chunks' own if they have one), so that texts are joined and shuffled once, with what
    is left, and by query: numbers and prompts that are made of them need no further shuffle."""
    place = F.col("rank").cast("bigint") * 4096 + F.col("offset") + 2048
    digest = F.col("digest") if "digest" in chunks.columns else F.md5("text")
    told = near.join(chunks.select(F.col("id").alias("near_id"), digest.alias("digest")), "near_id").select("query_id", "doc_name", "digest", "near_id", place.alias("at"))
    first = told.groupBy("query_id", "doc_name", "digest").agg(F.min("at").alias("at"), F.min_by("near_id", "at").alias("near_id"))
    texts = first.drop("digest").join(chunks.select(F.col("id").alias("near_id"), "text"), "near_id").drop("near_id").repartition("query_id")
    docs = texts.groupBy("query_id", "doc_name").agg(F.min("at").alias("at"), F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts"))
    order = Window.partitionBy("query_id").orderBy("at", "doc_name")
    return docs.withColumn("doc_ord", F.row_number().over(order)).select("query_id", "doc_name", "doc_ord", "texts")


def number_references(grouped: DataFrame) -> DataFrame:
    """``grouped`` with ``ref``: the documents of each query numbered from 1 by name."""
    return grouped.withColumn("ref", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_name")))


def hit_documents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, doc_name``: the documents of each query's context, which are those of its hits. No text is read.

    They are shuffled once, by query, where ``number_references`` finds them."""
    named = hits.select("query_id", "id").join(chunks.where("doc_name is not null").select("id", "doc_name"), "id")
    return named.select("query_id", "doc_name").repartition("query_id").distinct()


def _reference_lines() -> Column:
    line = F.concat(F.col("ref").cast("string"), F.lit(". "), F.col("doc_name"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ref", line.alias("line")))), lambda x: x["line"]), "\n")


def reference_lists(numbered: DataFrame) -> DataFrame:
    """``query_id, refs``: the list of references of each query by number."""
    return numbered.groupBy("query_id").agg(_reference_lines().alias("refs"))


def context_text(numbered: DataFrame, with_numbers: bool = True) -> DataFrame:
    """``query_id, docs, chunks, context, refs``: one row a query, documents in order of appearance, references by number."""
    head = F.concat(F.lit("### "), F.when(F.lit(with_numbers), F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] "))).otherwise(""), F.col("doc_name"), F.lit("\n"))
    block = F.concat(head, F.array_join("texts", GAP))
    rows = numbered.select("query_id", "doc_ord", "ref", "doc_name", "texts", block.alias("block")).groupBy("query_id")
    joined = rows.agg(
        F.count("*").alias("docs"),
        F.sum(F.size("texts")).alias("chunks"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_ord", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context"),
        _reference_lines().alias("refs"),
    )
    return joined


#: Slots of a prompt in the order in which they are filled; the template is the caller's.
DEFAULT_TEMPLATE = "Topic: {query}\n\nSources ({docs}):\n\n{context}\n\nAt least {words} words. Cite sources by number.\n\nReferences:\n{refs}\n"


def prompts(contexts: DataFrame, queries: DataFrame, template: str = DEFAULT_TEMPLATE, words: int = 800) -> DataFrame:
    """``query_id, prompt``: the template filled for every query with a context."""
    out = F.lit(template.replace("{words}", str(words)))
    for slot in ("query", "docs", "refs", "context"):
        out = F.replace(out, F.lit("{" + slot + "}"), F.col(slot).cast("string"))
    return contexts.join(queries.select("query_id", "query"), "query_id").select("query_id", out.alias("prompt"))


def chat_messages(contexts: DataFrame, turns: DataFrame) -> DataFrame:
    """``session_id, messages``: the turns ``(session_id, turn, role, content, query_id)`` of a session in order, user
    turns that have a context with it in front of their question."""
    head = F.concat(F.lit("[Retrieved "), F.col("chunks").cast("string"), F.lit(" chunks from "), F.col("docs").cast("string"), F.lit(" documents]\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("content"))
    filled = turns.join(contexts, "query_id", "left").select("session_id", "turn", F.struct("role", F.when(F.col("context").isNotNull(), head).otherwise(F.col("content")).alias("content")).alias("m"))
    return filled.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("messages"))


def source_list(hits: DataFrame, n: int = 150) -> DataFrame:
    """``query_id, doc_name, excerpt``: the documents of each query with the beginning of their best chunk."""
    return hits.groupBy("query_id", "doc_name").agg(F.min_by("text", "rank").alias("text")).select("query_id", "doc_name", excerpt(F.col("text"), n).alias("excerpt"))


def appendix(numbered: DataFrame) -> DataFrame:
    """``query_id, ref, doc_name, body``: the readable texts of every reference."""
    body = F.array_join(F.transform("texts", lambda t: format_chunk(t, F.regexp_extract(t, r"^\[([^\n\]]+)\]\n\n", 1))), "\n\n")
    return numbered.select("query_id", "ref", "doc_name", body.alias("body"))


def merge_staged(staged: DataFrame, fresh: DataFrame, key: str = "id", fallback: str = "doc_name") -> DataFrame:
    """The rows of ``staged`` and then of ``fresh`` that add something, by ``query_id`` and ``key`` (or ``fallback`` where
    that is null); of equal ones the first, in the order of ``rank``."""
    both = staged.withColumn("_source", F.lit(0)).unionByName(fresh.withColumn("_source", F.lit(1)))
    same = F.coalesce(F.col(key).cast("string"), F.col(fallback))
    order = Window.partitionBy("query_id", same).orderBy("_source", "rank")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumnRenamed("_source", "source")


def keep_authors(ranked: DataFrame, names: DataFrame, author: str) -> DataFrame:
    """The ranked rows of one author's documents. It follows the cut at top-k, so fewer than k may be left."""
    return ranked.join(names.where(F.col("author") == author).select("doc_name"), "doc_name", "left_semi")


def document_catalogue(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_name, chunks, characters, first_id, author, boost`` of every named document."""
    docs = chunks.where("doc_name is not null").groupBy("doc_name").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("characters"), F.min("id").alias("first_id"))
    return docs.join(names, "doc_name", "left")


def report_file_name(topic: Column) -> Column:
    """File name of a saved report: the topic's first 50 characters without what file systems refuse."""
    return F.regexp_replace(F.replace(F.replace(F.substring(topic, 1, 50), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-")), ":", "")


def evaluation_rows(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """``eval_id, result``: the kept hits of every case as one JSON document; cases without hits have an empty list."""
    row = F.struct("rank", "id", "doc_name", "relevance_score", "relevance_percent")
    kept = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("results"))
    joined = cases.join(kept, "query_id", "left").withColumn("results", F.coalesce("results", F.array().cast(kept.schema["results"].dataType)))
    return joined.select(F.col("query_id").alias("eval_id"), F.to_json(F.struct(F.col("query").alias("prompt"), F.size("results").alias("num_results"), "results")).alias("result"))


def printed_hits(hits: DataFrame) -> DataFrame:
    """``query_id, printed``: the hits ``(query_id, rank, doc_name, relevance_percent, text)`` of each query as plain text."""
    line = F.format_string("Result %d: %s\nRelevance: %d%%\n%s", "rank", F.coalesce("doc_name", F.lit("")), "relevance_percent", F.coalesce("text", F.lit("")))
    rows = hits.select("query_id", F.struct("rank", line.alias("line")).alias("r")).groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return rows.select("query_id", F.array_join(F.transform("rs", lambda r: r["line"]), "\n\n").alias("printed"))


def report_documents(bodies: DataFrame, contexts: DataFrame, generated: str) -> DataFrame:
    """``query_id, file_name, document``: the bodies ``(query_id, topic, body)`` as files with front matter and references."""
    head = F.concat(F.lit("---\ntopic: "), F.col("topic"), F.lit(f"\ngenerated: {generated}\n---\n\n"))
    document = F.concat(head, F.lit("Sources:\n"), F.coalesce("refs", F.lit("")), F.lit("\n\n"), F.col("body"))
    return bodies.join(contexts.select("query_id", "refs"), "query_id", "left").select("query_id", F.concat(report_file_name(F.col("topic")), F.lit(".md")).alias("file_name"), document.alias("document"))


def missing_files(expected: DataFrame, present: DataFrame, name: str = "file_name") -> DataFrame:
    """The rows of ``expected`` whose name isn't among ``present``."""
    return expected.join(present.select(name).distinct(), name, "left_anti")
