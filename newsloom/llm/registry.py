"""The queries of this subpackage, by name, with their DuckDB text where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_simhash_near_dedup": "simhash",
    "op2_token_counts": "tokencount",
    "op3_license_scan": "licenses",
    "op4_exact_topk": "topk",
    "op5_line_dedup": "linededup",
    "op6_language_id": "langid",
    "op7_sentencepiece": "pieces",
    "op8_substring_dedup": "substrings",
    "op9_quality_rules": "quality",
    "op10_source_mixing": "mixing",
}


def queries() -> dict:
    return {name: import_module(f"newsloom.llm.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: import_module(f"newsloom.llm.{module}").SQL for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
