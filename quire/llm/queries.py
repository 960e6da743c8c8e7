"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import importlib

#: query -> (module, name of the query's function, name of its SQL or None)
_TABLE = {
    "op1_language_id": ("langid", None),
    "op2_minhash_dedup": ("dedup", None),
    "op3_mixing": ("mixing", "ORACLE"),
    "op4_best_fit_packing": ("packing", None),
    "op5_sharding": ("sharding", "ORACLE"),
    "op6_quality_rules": ("quality_rules", "ORACLE"),
    "op7_token_counts": ("bpe", None),
    "op8_html_extraction": ("html_extract", None),
    "op9_media_avi": ("media", None),
    "op10_quality_classifier": ("cotraining", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"quire.llm.{module}"), name) for name, (module, _) in _TABLE.items()}


def oracle_sql() -> dict:
    return {name: getattr(importlib.import_module(f"quire.llm.{module}"), sql) for name, (module, sql) in _TABLE.items() if sql}
