"""The training-data queries and their SQL, by name."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage that has a function of that name.
MODULES = {
    "op1_pii": "pii",
    "op2_language": "langid",
    "op3_simhash": "simhash",
    "op4_suffix": "suffix_dedup",
    "op5_brown": "brown_lm",
    "op6_html": "html_extract",
    "op7_licenses": "license_scan",
    "op8_packing": "packing",
    "op9_decontamination": "decontam",
    "op10_webp": "webp",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"cuboid.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {}
