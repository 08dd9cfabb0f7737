"""All queries of the core library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import corpus, search
from lectern.plans.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

_CORPUS = (
    "chunk_sentences chunk_pack section_chunks chunk_table chunk_positions corpus_stats list_documents doc_catalogue "
    "known_authors tokenize_bm25 term_df tfidf_vocab tfidf_weights stored_weights index_metrics embedded_chunks stale_embeddings excerpts formatted_chunks view_source "
    "frontmatter transcripts transcript_files normalized_texts toc_tokens toc_entries toc_files ocr_entries page_map nearest_page "
    "article_extents article_text article_records issue_contents tier_rollup"
)
_SEARCH = (
    "search_bm25 search_tfidf search_cli search_keyword search_combined search_top_docs search_embedding search_hybrid "
    "author_filter score_labels context_window context_group report_refs prompt_rows appendix chat_messages chat_sources "
    "staged_merge eval_run cli_print run_modes report_files"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: getattr(m, n) for m, ns in ((corpus, _CORPUS), (search, _SEARCH)) for n in ns.split()}
