"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from quillon.llm import centroids, exact_dedup, html_extract, merkle, mixing, ngram_join, packing, pii, quality, token_counts, topk_search, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_warc": warc.op5_warc,
    "op6_packing": packing.op6_packing,
    "op7_pii": pii.op7_pii,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_topk_search": topk_search.op10_topk_search,
    "op11_centroids": centroids.op11_centroids,
    "op12_merkle": merkle.op12_merkle,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op10_topk_search": topk_search.OP10_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
}
