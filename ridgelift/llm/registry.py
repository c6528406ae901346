"""The queries of this subpackage, and SQL twins where SQL can express them."""

from __future__ import annotations

from . import edit_fingerprint, fill_middle, katz, license_scan, mixing, near_dup, nearest, packing, pieces, quality, ranked_search, secret_scan, substring_dedup


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_fingerprints": edit_fingerprint.op2_fingerprints,
        "op3_mixing": mixing.op3_mixing,
        "op4_nearest": nearest.op4_nearest,
        "op5_katz": katz.op5_katz,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_near_dup": near_dup.op9_near_dup,
        "op10_quality": quality.op10_quality,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_packing": packing.op12_packing,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.OP3_SQL,
        "op9_near_dup": near_dup.OP9_SQL,
        "op11_ranked_search": ranked_search.OP11_SQL,
        "op13_fill_middle": fill_middle.OP13_SQL,
    }
