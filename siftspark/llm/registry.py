"""The operators' queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from . import decontaminate, exact, extraction, language, pieces, quality, shards, simhash, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.toxic_documents,
    "op2_language_id": language.document_languages,
    "op3_histogram_sort": shards.sharded_documents,
    "op4_benchmark_decontamination": decontaminate.benchmark_leaks,
    "op5_sentencepiece": pieces.document_pieces,
    "op6_html_extraction": extraction.page_texts,
    "op7_quality_classifier": quality.document_quality,
    "op8_exact_dedup": exact.exact_copies,
    "op9_url_filter": urls.page_urls,
    "op10_simhash_near_dedup": simhash.simhash_groups,
}

ORACLE: dict[str, str] = {
    "op3_histogram_sort": shards.SHARDS_SQL,
    "op8_exact_dedup": exact.EXACT_SQL,
}
