"""Operators for preparing training text, each a module of its own with its query and SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name: the module that holds the function of that name, and its SQL if it has any.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_lm_score": "lm_score",
    "op3_bpe_codec": "bpe_codec",
    "op4_quality_fm": "quality_fm",
    "op5_mix_sources": "mixing",
    "op6_exact_dedup": "exact_dedup",
    "op7_chat_format": "chat_format",
    "op8_license_scan": "license_scan",
    "op9_quality_rules": "quality_rules",
    "op10_near_dedup": "near_dedup",
    "op11_source_divergence": "source_audit",
    "op12_token_alignment": "token_align",
    "op13_personal_data": "personal_data",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
