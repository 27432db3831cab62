"""The queries of this package and their DuckDB counterparts, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_url_filter": "url_filters",
    "op3_line_dedup": "line_dedup",
    "op4_mix_sources": "mixing",
    "op5_quality_classifier": "quality_cnn",
    "op6_pii": "pii",
    "op7_ngram_jaccard": "ngram_join",
    "op8_byte_bpe": "byte_bpe",
    "op9_ann": "ann_tree",
    "op10_quality_rules": "quality_rules",
    "op11_exact_dedup": "exact_dedup",
    "op12_phrases": "phrases",
    "op13_merkle_manifest": "merkle",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
