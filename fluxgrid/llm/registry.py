"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from fluxgrid.llm import filter_audit, html_text, link_filter, media, mixing, ngram_join, packing, periodic, quality, repair, substring_dedup, toxicity, vector_join

QUERIES = {
    "op1_media_copies": media.op1_media_copies,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_repair_tokens": repair.op4_repair_tokens,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_link_filter": link_filter.op7_link_filter,
    "op8_near_vectors": vector_join.op8_near_vectors,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
ORACLE_SQL = {
    "op2_ngram_jaccard": ngram_join.OP2_SQL,
    "op7_link_filter": link_filter.OP7_SQL,
    "op8_near_vectors": vector_join.OP8_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_substring_dedup": substring_dedup.OP13_SQL,
}
