"""Registered queries of this subpackage: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = [
    "op1_ngram_join",
    "op2_bitpack",
    "op3_chat",
    "op4_embedding_dedup",
    "op5_quality",
    "op6_ann",
    "op7_toxicity",
    "op8_mixing",
    "op9_bpe",
    "op10_substring_dedup",
    "op11_centroids",
    "op12_exact_dedup",
    "op13_filter_audit",
]


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(f"ferrule.llm.{name}").QUERIES)
    return out
