"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, filter_audit, hard_negatives, html_text, imatch, license_scan, near_dedup, packing, secret_scan, sharding, topk_search, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_secret_scan": secret_scan.query,
        "op3_html_text": html_text.query,
        "op4_license_scan": license_scan.query,
        "op5_imatch": imatch.query,
        "op6_sharding": sharding.query,
        "op7_near_dedup": near_dedup.query,
        "op8_packing": packing.query,
        "op9_byte_bpe": byte_bpe.query,
        "op10_exact_dedup": exact_dedup.query,
        "op11_topk_search": topk_search.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql() -> dict:
    return {"op10_exact_dedup": exact_dedup.SQL, "op11_topk_search": topk_search.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_filter_audit": filter_audit.SQL}
