"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "html_extract", "simhash", "quality_rules", "line_dedup", "packing", "quality_classifier", "exact_dedup", "url_rules", "bpe")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"postalloom.llm.{_name}")
    QUERIES[_module.NAME] = _module.query
    if _module.ORACLE:
        ORACLES[_module.NAME] = _module.ORACLE
