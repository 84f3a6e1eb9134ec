"""The queries of this package and the SQL that expresses them."""

from __future__ import annotations

from . import decontam, html_extract, language, lexical, line_dedup, mixing, pii, prefix_trie, simhash, token_store, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_token_store": token_store.op2_token_store,
        "op3_exact_topk": topk.op3_exact_topk,
        "op4_simhash": simhash.op4_simhash,
        "op5_html_extraction": html_extract.op5_html_extraction,
        "op6_mixing": mixing.op6_mixing,
        "op7_pii": pii.op7_pii,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_language_id": language.op12_language_id,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op3_exact_topk": topk.ORACLE_SQL,
        "op6_mixing": mixing.ORACLE_SQL,
        "op10_url_filter": url_filter.ORACLE_SQL,
        "op11_lexical_search": lexical.ORACLE_SQL,
        "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    }
