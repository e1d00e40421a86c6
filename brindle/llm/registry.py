"""The numbered queries and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import chroma, codes, html_diff, kneser_ney, minhash, mixing, packing, quality_rules, secrets, substrings, toxicity, vantage, winnowing


def queries() -> dict[str, Callable]:
    return {
        "op1_html_extraction": html_diff.query,
        "op2_quality_classifier": kneser_ney.query,
        "op3_chroma_fingerprints": chroma.query,
        "op4_minhash_dedup": minhash.query,
        "op5_secret_scan": secrets.query,
        "op6_toxicity": toxicity.query,
        "op7_substring_dedup": substrings.query,
        "op8_packing": packing.query,
        "op9_quality_rules": quality_rules.query,
        "op10_mixing": mixing.query,
        "op11_vector_codes": codes.query,
        "op12_vantage_clusters": vantage.query,
        "op13_winnowing": winnowing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_quality_rules": quality_rules.oracle(),
        "op10_mixing": mixing.oracle(),
        "op11_vector_codes": codes.oracle(),
        "op12_vantage_clusters": vantage.oracle(),
        "op13_winnowing": winnowing.oracle(),
    }
