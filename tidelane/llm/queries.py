"""Queries of this subpackage, one for each operator, and their SQL where there is some."""

from __future__ import annotations

import importlib

#: Module of each query.
QUERIES = {
    "op1_sentence_pieces": "sentence_pieces",
    "op2_token_files": "token_files",
    "op3_word_pieces": "word_pieces",
    "op4_language": "language",
    "op5_quality": "quality",
    "op6_shards": "shards",
    "op7_near_dedup": "near_dedup",
    "op8_mix": "mixing",
    "op9_secrets": "secrets",
    "op10_lattice": "lattice",
    "op11_collocations": "collocations",
    "op12_page_text": "page_text",
    "op13_fill_in_middle": "fill_in_middle",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tidelane.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in QUERIES.items():
        sql = getattr(importlib.import_module(f"tidelane.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
