"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, binary, decontaminate, html_text, langid, mixing, negatives, quality, search, secrets, simhash, substring, token_counts


def queries() -> dict:
    return {
        "op1_quality_kneser_ney": quality.op1_quality_kneser_ney,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_simhash_vptree": simhash.op3_simhash_vptree,
        "op4_multi_index_hashing": ann.op4_multi_index_hashing,
        "op5_language_id": langid.op5_language_id,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_binary_ids": binary.op8_binary_ids,
        "op9_pareto_mixing": mixing.op9_pareto_mixing,
        "op10_html_text": html_text.op10_html_text,
        "op11_fm_substrings": substring.op11_fm_substrings,
        "op12_ranked_search": search.op12_ranked_search,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_fm_substrings": substring.ORACLE_SQL,
        "op12_ranked_search": search.ORACLE_SQL,
        "op13_hard_negatives": negatives.ORACLE_SQL,
    }
